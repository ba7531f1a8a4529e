"""Web pages: WARC files read by several tasks against a plain reader, and main text against labelled pages."""

import gzip
import random
import zlib

import pytest

from webloom.sources import pages, tables, warc


def member(url, body, kind="response", head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8", level=6):
    block = head + b"\r\n\r\n" + body if kind == "response" else body
    type_ = b"application/http; msgtype=response" if kind == "response" else b"application/warc-fields"
    data = b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Target-URI: " + url.encode() + b"\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Type: " + type_ + b"\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, level)


def plain_reader(path):
    """Bodies by url, one gzip member after the other."""
    data, out = path.read_bytes(), []
    while data:
        unpack = zlib.decompressobj(31)
        head, _, block = unpack.decompress(data).partition(b"\r\n\r\n")
        data = unpack.unused_data
        url = head.split(b"WARC-Target-URI: ")[1].split(b"\r\n")[0].decode()
        out.append((url, block[: int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])]))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(0)
    root = tmp_path_factory.mktemp("warc")
    for k in range(3):
        with (root / f"part-{k}.warc.gz").open("wb") as f:
            f.write(member("info", b"software: x", kind="warcinfo"))
            for i in range(60):
                # Bodies with gzip members of their own inside, incompressible ones, long and empty ones.
                body = rng.choice([b"", b"<p>short</p>", rng.randbytes(9_000), gzip.compress(b"inner"), warc.MAGIC * 50, f"<p>{'wörd ' * rng.randrange(4_000)}</p>".encode()])
                f.write(member(f"http://h/{k}/{i}", body, level=rng.choice([0, 6])))
    return root


@pytest.mark.parametrize("split", [700, 4_096, 50_000, 64 << 20])
def test_files_are_read_alike_however_they_are_cut(spark, folder, split):
    df = warc.read_warc(spark, str(folder), split_bytes=split)
    if split < 10_000:
        assert df.rdd.getNumPartitions() > 20
    got = sorted((r["target_uri"], bytes(r["payload"])) for r in df.collect())
    want = []
    for path in sorted(folder.glob("*.warc.gz")):
        want += [(u, b.partition(b"\r\n\r\n")[2] if b.startswith(b"HTTP/") else b) for u, b in plain_reader(path)]
    assert got == sorted(want) and len(got) == 3 * 61


def test_one_file_and_columns(spark, folder):
    df = warc.read_warc(spark, str(folder / "part-1.warc.gz"))
    r = df.where("target_uri = 'http://h/1/0'").first()
    assert (r["warc_type"], r["date"], r["http_status"], r["http_content_type"]) == ("response", "2026-01-01T00:00:00Z", 200, "text/html; charset=utf-8")
    assert df.where("warc_type = 'warcinfo'").count() == 1
    with pytest.raises(Exception, match="no WARC files"):
        warc.read_warc(spark, str(folder / "none")).count()


def test_http_encodings_charsets_and_what_is_no_page(spark, tmp_path):
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked"
    rows = [
        member("a", b"4\r\n<p>a\r\n3;x=y\r\nbc<\r\n0\r\n\r\n", head=chunked), member("b", b"<p>not chunked</p>", head=chunked),
        member("c", gzip.compress(b"<p>zipped</p>"), head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip"),
        member("d", "<p>Öl</p>".encode("latin-1"), head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1"),
        member("e", '<meta charset="latin-1"><p>é'.encode("latin-1"), head=b"HTTP/1.1 200 OK"), member("f", b"\xff<p>", head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense"),
        member("g", b"{}", head=b"HTTP/1.1 200 OK\r\nContent-Type: application/json"), member("h", b"gone", head=b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(rows) + rows[0][:-30])  # the last one cut off
    got = {r["url"]: r["html"] for r in warc.warc_pages(warc.read_warc(spark, str(tmp_path / "x.warc.gz"))).collect()}
    assert got == {"a": "<p>abc<", "b": "<p>not chunked</p>", "c": "<p>zipped</p>", "d": "<p>Öl</p>", "e": '<meta charset="latin-1"><p>é', "f": "�<p>"}


LONG = "This is a paragraph of the article with enough words in it to be taken for content by its length alone, "
PAGES = [
    # Each line: whether it is content, and the HTML of a block.
    [(0, '<div class="menu"><a href="/a">Home</a> | <a href="/b">News</a> | <a href="/c">All our other offers today</a></div>'), (1, "<article><h1>A heading</h1>"), (1, f"<p>{LONG}one.</p>"), (1, "<p>Short end.</p></article>"), (0, "<footer>Copyright of somebody, all rights reserved by the company and its many partners in the world</footer>")],
    [(0, "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(9)) + "</ul>"), (1, f"<div>{LONG}two.</div>"), (1, "<div>In between.</div>"), (1, f"<div>{LONG}three.</div>"), (0, "<div>Advertisement</div>"), (0, '<p><a href="/more">Read more of the same kind of thing here and there and everywhere in this place</a></p>')],
    [(0, "<nav>Where you are: a long list of words that stand in the navigation and are no links at all, however many</nav>"), (1, f"<main><p>{LONG}four<p>{LONG}unclosed"), (1, "<p>And <b>a <i>bold</b> end</i></main>"), (0, "<form>Subscribe to our newsletter and give us your address and all that you know about your friends</form>")],
]


@pytest.mark.parametrize("page", PAGES)
def test_navigation_goes_and_content_stays(page):
    html = "<html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body>" + "".join(h for _, h in page) + "</body></html>"
    lines = pages.main_text(html).split("\n")
    for keep, block in page:
        for text in (b.text for b in pages.page_blocks(block)):
            assert (text in lines) == bool(keep), text
    assert "no" not in lines and "T" not in lines


def test_pages_without_long_blocks_or_without_text():
    assert pages.main_text(None) is None and pages.main_text("") == "" and pages.main_text("<p> </p>") == ""
    assert pages.main_text("<nav>menu</nav><p>Only this &amp; that</p>") == "Only this & that"
    assert pages.main_text('<a href="/">all</a><a href="/x">links</a>') == ""
    assert pages.main_text("<p>" + "word " * 300_000 + "</p>").count("word") == 300_000


def test_given_pages_lose_their_frame(spark):
    df = tables.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for r in df.collect():
        assert "©" not in r["text"] and "track(" not in r["text"]
        nav = [b.text for b in pages.page_blocks(r["html"]) if b.links == len(b.text)]
        assert nav and not set(nav) & set(r["text"].split("\n"))
        longest = max((b for b in pages.page_blocks(r["html"]) if not b.links), key=lambda b: b.words)
        assert longest.text in r["text"]


def test_packs_of_records_are_bounded(spark):
    """Large pages of one batch go into several packs, and all come back."""
    from pyspark.sql import functions as F

    from webloom.sources import warc

    pages = spark.range(0, 40, 1, 1).select(F.concat(F.lit("u"), "id").alias("url"), F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256))).alias("html"))
    packs = warc.packed_records(pages)
    assert packs.agg(F.max(F.octet_length("warc"))).first()[0] < 2 << 20 and packs.count() > 1
    got = warc.warc_pages(warc.unpacked_records(packs)).select("url", F.md5(F.col("html").cast("binary")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pages.select("url", F.md5(F.col("html").cast("binary"))).collect()))
