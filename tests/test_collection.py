import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions.hashing import rank_hash
from webloom.operators import crawls, filters, measure, mixture, near_duplicates, release, sidecars, store
from webloom.plans import catalog
from webloom.sources import tables, transfer

FOLDER = "/root/testdata/sf0.001"


# --- filter recipe ---------------------------------------------------------------------------------------------------


def plain_repeats(text):
    words = text.split()
    for n, most in filters.TOP_GRAMS.items():
        grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        if grams:
            top, times = Counter(grams).most_common(1)[0]
            if len(top) * times / len(text) > most:
                return True
    for n, most in filters.REPEATED_GRAMS.items():
        seen, total, i = set(), 0, 0
        while i + n <= len(words):
            gram = tuple(words[i : i + n])
            if gram in seen:
                total, i = total + sum(map(len, gram)), i + n
            else:
                seen.add(gram)
                i += 1
        if total / len(text) > most:
            return True
    return False


def test_repeated_grams_against_a_loop():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["to", "be", "or", "not", "that", "question"][: rng.randint(2, 6)]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [" ".join(f"w{i}" for i in range(50)) + " " + " ".join(f"w{i}" for i in range(k)) for k in range(0, 50, 3)] + ["word"]
    assert [filters.repeats(t) for t in texts] == [plain_repeats(t) for t in texts]
    assert not filters.repeats("") and not filters.repeats(" ".join(f"w{i}" for i in range(500)))


def plain_audit(text, lang):
    """First failing stage, by a plain reading of the rules."""
    split = lambda t: [w for w in re.split(r"\s+", t) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    paragraphs = [x for x in re.split(r"\n{2,}", text) if x.strip(" ")]
    dup = lambda xs: (len(xs) - len(set(xs))) / len(xs) if xs else 0
    chars = lambda xs, n: (sum(map(len, xs)) - sum(map(len, set(xs)))) / n if n else 0
    if lang != "en":
        return "language"
    if max(dup(lines), dup(paragraphs)) > 0.3 or max(chars(lines, len(text)), chars(paragraphs, len(text))) > 0.2 or plain_repeats(text):
        return "gopher_repetition"
    words, share = split(text), lambda test: sum(map(bool, map(test, lines))) / len(lines) if lines else 0
    if not (50 <= len(words) <= 100_000 and 3 <= sum(map(len, words)) / len(words) <= 10 and len(re.findall(r"#|\.\.\.|…", text)) / len(words) <= 0.1):
        return "gopher_quality"
    if share(lambda x: re.match(r"\s*[•*-]", x)) > 0.9 or share(lambda x: re.search(r"(\.\.\.|…)\s*$", x)) > 0.3 or sum(bool(re.search("[A-Za-z]", w)) for w in words) / len(words) < 0.8 or len({w.lower() for w in words} & set(filters.STOP_WORDS)) < 2:
        return "gopher_quality"
    policy = re.compile("javascript|terms of use|privacy policy|cookie policy|uses cookies|use of cookies|use cookies")
    edited = "\n".join(x for x in text.split("\n") if len(split(x)) >= 3 and not policy.search(x.lower()))
    if "lorem ipsum" in text.lower() or "{" in text or len(re.findall(r"[.!?](?:\s|$)", edited)) < 5:
        return "c4"
    rows = [x for x in edited.split("\n") if x.strip(" ")]
    if not rows or sum(x.rstrip(" ")[-1:] in filters.LINE_ENDS for x in rows) / len(rows) <= 0.12 or sum(len(x) < 30 for x in rows) / len(rows) >= 0.67 or chars(rows, len(edited.replace("\n", ""))) > 0.1:
        return "fineweb_quality"
    return None


def test_filter_audit_against_a_plain_reading(spark):
    good = "\n".join(f"This is the sentence number {i} of {i * 7} and it has enough words of that kind to be kept with others." for i in range(8))
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs += [(-i - 1, t, "en") for i, t in enumerate([good, good + "\n" + good, good.replace("This", "{ This"), "\n\n".join([good[:90]] * 9), good.replace(".", "..."), good.replace("\n", "\nUse cookies here now\n"), good.replace("sentence", "a b c d e f g h i j k l m n o p")])]
    found = filters.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert {i: r["removed_at"] for i, r in got.items()} == {i: plain_audit(t, lang) for i, t, lang in docs}
    for r in got.values():
        alive = [r[s] for s in filters.STAGES]
        assert alive == sorted(alive, reverse=True) and (r["removed_at"] is None) == alive[-1]


def test_filters_split_each_text_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (filters.apply_filters(docs), filters.audit(docs).where("c4"), near_duplicates.with_bands(near_duplicates.with_shingles(docs, "doc_id", "text", F.lit("")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Filter" in x.split("(")[0] and "split(" in x]
    plan = filters.audit(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 6


def test_blocked_hosts_come_first(spark):
    docs = spark.createDataFrame([(1, "x", "en", "https://Bad.example/a"), (2, "x", "de", "https://good.example/b"), (3, "x", "en", None)], "id long, text string, lang string, url string")
    listed = spark.createDataFrame([("bad.example",), ("BAD.example",)], ["host"])
    out = {r["id"]: r["removed_at"] for r in filters.audit(docs, url_col="url", blocklist=listed).collect()}
    assert out[1] == "url_filter" and out[2] == "language" and out[3] == "gopher_quality"
    assert [r["id"] for r in tables.blocked_hosts(docs.where("url is not null"), listed).collect()] == [2]


def test_near_duplicate_groups_against_a_loop(spark):
    """Groups by shared bands, from the same signatures, merged one by one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    signed = near_duplicates.with_bands(near_duplicates.with_shingles(docs, "doc_id", "text", F.col("lang"))).collect()
    root = {r["id"]: r["id"] for r in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for r in sorted(signed, key=lambda r: r["id"]):
        for band, key in enumerate(r["bands"]):
            a, b = find(first.setdefault((r["part"], band, key), r["id"])), find(r["id"])
            root[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in catalog.QUERIES["near_duplicate_groups"](spark, FOLDER).collect()}
    assert got == {i: find(i) for i in root}


# --- sidecars --------------------------------------------------------------------------------------------------------


def test_sidecars_are_made_shard_by_shard(spark, tmp_path):
    folder, side = str(tmp_path / "docs"), str(tmp_path / "side")
    spark.range(40).selectExpr("cast(id as string) as id", "concat('text ', id) as text").repartition(4).write.parquet(folder)
    calls = []

    def label(df):
        calls.append(df.select("file_name").distinct().count())
        return df.withColumn("label", F.when(F.col("id") % 2 == 0, "AI").otherwise("Human"))

    assert sidecars.label_missing(spark, folder, side, ["text"], label) == 4
    assert sidecars.label_missing(spark, folder, side, ["text"], label) == 0 and calls == [4, 0]
    spark.range(40, 50).selectExpr("cast(id as string) as id", "concat('text ', id) as text").coalesce(1).write.mode("append").parquet(folder)
    assert sidecars.label_missing(spark, folder, side, ["text"], label) == 1
    docs, made = tables.ordered_scan(spark, folder, ["id", "text"]), spark.read.parquet(side)
    out = sidecars.joined(docs, {"x": made, "y": made.select("id", "file_name", "row_index", "label")}).collect()
    assert len(out) == 50 and all(r["x_label"] == r["y_label"] == ("AI" if int(r["id"]) % 2 == 0 else "Human") for r in out)
    with pytest.raises(Exception, match="another id"):
        sidecars.joined(docs, {"x": made.withColumn("id", F.lit("z"))}).collect()
    with pytest.raises(Exception, match="another id"):
        sidecars.joined(docs, {"x": made.where("row_index > 0")}).collect()
    with pytest.raises(Exception, match="more than once"):
        sidecars.joined(docs, {"x": made.unionByName(made)}).collect()
    with pytest.raises(ValueError, match="places"):
        sidecars.label_missing(spark, folder, str(tmp_path / "bad"), ["text"], lambda df: df.withColumn("id", F.lit("other")))
    assert sidecars.mirror_path("/a/b/c/part-0.parquet", "/a/b", "/x") == "/x/c/part-0.parquet"


def test_a_misaligned_sidecar_is_an_error_whatever_is_read(spark):
    docs = spark.createDataFrame([("f", 0, 1, "d", "x"), ("f", 1, 2, "d", "y")], "file_name string, row_index long, id long, dump string, text string")
    side = spark.createDataFrame([("f", 0, 1, "AI"), ("f", 1, 9, "Human")], "file_name string, row_index long, id long, label string")
    out = sidecars.joined(docs, {"l": side})
    for read in (out, out.select("dump", "l_label"), out.select("dump"), out.groupBy("l_label").count(), out.where("l_label = 'Human'").select("text")):
        with pytest.raises(Exception, match="f row 1 has another id"):
            read.collect()
    with pytest.raises(Exception, match="another id"):
        out.count()
    right = sidecars.joined(docs, {"l": side.withColumn("id", F.col("row_index") + 1)}).select("dump", "l_label").collect()
    assert sorted(map(tuple, right)) == [("d", "AI"), ("d", "Human")]


def test_tables_laid_out_by_file_are_joined_without_a_shuffle(spark):
    docs = spark.range(900).selectExpr("concat('f', id % 7) AS file_name", "id div 7 AS row_index", "id", "repeat('word ', 200) AS text")
    side = docs.selectExpr("file_name", "row_index", "id", "id % 3 AS label").repartition(5)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lying = [sidecars.laid_out_by_file(x) for x in (docs, side, side.withColumnRenamed("label", "topic"))]
        out = sidecars.joined(lying[0], {"l": lying[1], "t": lying[2]})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) == 900 and all(r["l_label"] == r["t_topic"] == r["id"] % 3 and r["text"] for r in rows)


def test_label_rows(spark):
    df = spark.createDataFrame([("success", "4", "AI", None), ("error", None, None, "too short"), (None, None, None, None)], "o string, v string, l string, e string")
    row = sidecars.label_row(F.col("o"), F.col("v"), "4", F.col("l"), ("AI", "Human"), F.col("e"))
    assert [tuple(r["r"]) for r in df.select(row.alias("r")).collect()] == [("AI", None), (None, "too short"), (None, "no answer")]
    for wrong, match in ((("success", "3", "AI", None), "version"), (("success", "4", "Robot", None), "no label")):
        with pytest.raises(Exception, match=match):
            spark.createDataFrame([wrong], df.schema).select(row).collect()


# --- crawls ----------------------------------------------------------------------------------------------------------


def crawl(spark):
    return spark.range(120).selectExpr("id", "concat('d', id % 2) as dump", "concat('f', id div 60) as file_name", "id % 60 as row_index", "5 as tokens", "concat('2026-0', 1 + id % 3, '-11') as date")


def test_blocks_stay_whole_and_in_order(spark):
    rows = crawls.in_block_order(crawl(spark), 3, 10)
    assert rows.select("block_hash").distinct().count() == 24
    assert rows.select("block_hash").distinct().collect() != crawls.in_block_order(crawl(spark), 4, 10).select("block_hash").distinct().collect()
    for needed in (1, 5, 17, 1_000):
        got, total = crawls.until_enough(rows, F.col("id") % 3 == 0, needed).collect(), 0
        expected = []
        blocks = {}
        for r in rows.collect():
            blocks.setdefault(r["block_hash"], []).append(r["id"])
        for h in sorted(blocks):
            if total < needed:
                expected += blocks[h]
            total += sum(i % 3 == 0 for i in blocks[h])
        assert sorted(r["id"] for r in got) == sorted(expected)
    assert crawls.collected(crawl(spark), 3, 10, 52).groupBy("dump").count().collect()[0]["count"] == 11


def test_month_samples(spark):
    assert crawls.month_sample(crawl(spark), "2026-02", 7, "k").count() == 7
    with pytest.raises(ValueError):
        crawls.month_sample(crawl(spark), "2026-02", 41, "k")


def test_stages_resume(spark, tmp_path):
    built = []

    def build(files):
        built.append(files)
        return spark.createDataFrame([(f,) for f in files], ["file"])

    for _ in range(2):
        out = crawls.in_batches(spark, ["a", "b", "c"], 2, str(tmp_path / "b"), build)
        assert sorted(r["file"] for r in out.collect()) == ["a", "b", "c"]
    assert built == [["a", "b"], ["c"]]
    (tmp_path / "b" / "batch-00001" / "_SUCCESS").unlink()
    crawls.in_batches(spark, ["a", "b", "c"], 2, str(tmp_path / "b"), build)
    assert built[2:] == [["c"]]
    with pytest.raises(ValueError):
        crawls.in_batches(spark, [], 2, str(tmp_path / "c"), build)


# --- release, store --------------------------------------------------------------------------------------------------


def test_release_replaces_personal_data_where_it_was_not_done(spark, tmp_path):
    rows = [("a", "mail x@y.com now", "d", 3, True, "f", 0), ("b", "mail x@y.com now", "d", 3, False, "f", 1), ("c", "clean", "d", 1, None, "f", 2)]
    pool = spark.createDataFrame(rows, "id string, text string, dump string, token_count long, pii_anonymized boolean, file_name string, row_index long")
    topics = pool.select("id", "file_name", "row_index", F.lit("t").alias("topic"))
    columns = "id string, text string, topics_topic string, token_count bigint, pii_anonymized boolean, label string"
    out = {r["id"]: r for r in release.released_pool(pool, "ai", topics, columns).collect()}
    assert out["a"]["text"] == "mail x@y.com now" and out["b"]["text"] == "mail email@example.com now" and {r["label"] for r in out.values()} == {"AI"}
    pools = {p: release.released_pool(pool, p, topics, columns) for p in ("ai", "human")}
    release.write_pools(pools, str(tmp_path), order=["id"])
    labels = spark.read.parquet(str(tmp_path / "labels"))
    assert labels.count() == 6 and "text" not in labels.columns and spark.read.parquet(str(tmp_path / "ai")).columns[1] == "text"
    assert release.release_schema("id string, text string", with_text=False, with_windows=True).startswith("id string, windows array")


def test_token_store(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * (i % 5) + "end") for i in range(60)], "id long, text string").withColumn("h", F.substring(rank_hash("s", "id"), 1, 16))
    made = store.build_store(docs, str(tmp_path / "s"), lambda t: F.transform(F.split(t, " "), lambda w: F.char_length(w)))
    rows = sorted(made.collect(), key=lambda r: r["key"])
    flat, at = [], 0
    for r in rows:
        assert r["offset"] == at and r["length"] == len(r["tokens"])
        at += r["length"]
        flat += r["tokens"]
    for a, b in ((0, 10), (17, 60), (5, 6), (0, 10_000)):
        part = [t for r in sorted(store.read_range(made, a, b).collect(), key=lambda r: r["key"]) for t in r["tokens"]]
        assert part == flat[a:b]
    half = store.build_store(docs, str(tmp_path / "h"), lambda t: F.array(F.lit(1)), share=0.5)
    assert {r["key"] for r in half.collect()} == {r["key"] for r in rows if r["key"] < "8"}
    with pytest.raises(ValueError):
        store.build_store(docs.unionByName(docs), str(tmp_path / "x"), lambda t: F.array(F.lit(1)))


# --- sources ---------------------------------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, [1, 2]), (2, None, 0.5, [])], "id int, s string, x double, l array<int>")
    tables.write_csv(df, str(tmp_path / "c"))
    back = tables.typed_csv(spark, str(tmp_path / "c"), "id int, s string, x double, l string")
    assert {tuple(r) for r in back.collect()} == {(1, "a", None, "1;2"), (2, None, 0.5, None)}
    assert tables.records(spark, str(tmp_path / "c"), "id int, s string, x double, l string", id=2).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|number"):
        tables.typed_csv(spark, str(tmp_path / "c"), "id int, s int, x double, l string").collect()
    tables.write_csv(df.where("false"), str(tmp_path / "c"))
    assert not (tmp_path / "c").exists()
    tables.write_json_lines(df, str(tmp_path / "j"))
    assert tables.json_lines(spark, str(tmp_path / "j"), "id int, s string").count() == 2
    (tmp_path / "paths.txt").write_text("a\n\n  b \nc\n")
    assert [(r["place"], r["path"]) for r in tables.path_list(spark, str(tmp_path / "paths.txt")).collect()] == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "v.txt").write_text("one\n\ntwo\n")
    assert [r["line"] for r in tables.verified_bytes(spark, str(tmp_path / "v.txt"), hashlib.sha256(b"one\n\ntwo\n").hexdigest()).collect()] == ["one", "two"]
    with pytest.raises(Exception, match="digest"):
        tables.verified_bytes(spark, str(tmp_path / "v.txt"), "00").collect()
    df.write.parquet(str(tmp_path / "p" / "x"))
    assert tables.recursive_scan(spark, str(tmp_path / "p")).count() == 2 and tables.shard_names(spark, str(tmp_path / "p" / "x"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.shard_names(spark, str(tmp_path / "none"))
    (tmp_path / "set.jsonl").write_text('{"text":"t","subdomain":"","source":"s"}\n{"text":""}\n{"text":"u","subdomain":"d"}\n{"text":"v","subset":"z"}\n')
    assert {(r["domain"], r["text"]) for r in tables.set_sources(spark, {"x": str(tmp_path / "set.jsonl")}).collect()} == {("s", "t"), ("d", "u"), ("z", "v")}
    (tmp_path / "audit.json").write_text('{"one": {"stages": [{"stage": "a", "kept": 5}, {"stage": "b", "kept": 3}]}}')
    assert [tuple(r) for r in tables.audit_stages(spark, str(tmp_path / "audit.json")).collect()] == [("one", 0, "a", 5), ("one", 1, "b", 3)]
    assert tables.drawn_frame(["a", "b", "c", "d"], 2, "k")[0][1] == 0.5 and tables.dump_path("hub/x", "v1", "d") == "hub/x@v1/data/d"
    with pytest.raises(ValueError):
        tables.dump_path("hub/x", "", "d")


def test_transfers(tmp_path):
    waits, log = [], []

    def send(method, url):
        log.append(url)
        outcome = answers.pop(0)
        if isinstance(outcome, Exception):
            raise outcome
        return outcome

    answers = [transfer.Answer(503, headers={"Retry-After": "7"}), OSError("cut"), transfer.Answer(200, b"body")]
    path = transfer.download(send, "u", tmp_path / "a" / "f", sleep=waits.append)
    assert path.read_bytes() == b"body" and waits == [7.0, 2.0] and [p.name for p in path.parent.iterdir()] == ["f"]
    assert transfer.download(send, "u", path) == path and len(log) == 3
    answers = [OSError("cut")]
    with pytest.raises(OSError, match="cut"):
        transfer.request(send, "POST", "u", sleep=waits.append)
    answers = [transfer.Answer(500)]
    with pytest.raises(OSError, match="500"):
        transfer.request(send, "POST", "u", sleep=waits.append)
    answers = [transfer.ConnectTimeout(), transfer.Answer(429), transfer.Answer(201)]
    assert transfer.request(send, "POST", "u", sleep=waits.append).status == 201
    answers = [transfer.Answer(500)] * 3
    with pytest.raises(OSError):
        transfer.request(send, "GET", "u", attempts=3, sleep=waits.append)
    assert transfer.retry_delay(9) == 60 and transfer.retry_delay(2, "soon") == 4 and transfer.retry_delay(0, "900") == 60
    answers = [transfer.Answer(200, b"x")] * 3
    assert [p.name for p in transfer.download_all(send, [(f"u{i}", tmp_path / f"g{i}") for i in range(3)])] == ["g0", "g1", "g2"]


# --- intervals, order statistics, packing ----------------------------------------------------------------------------


def test_poisson_interval_is_that_of_resampling(spark):
    rng = random.Random(0)
    rows = [(i, "a", rng.randint(1, 50), "AI" if rng.random() < 0.3 else "Human") for i in range(4_000)]
    df = spark.createDataFrame(rows, "id long, dump string, tokens long, label string")
    p = measure.poisson_interval(df.repartition(7), "dump", "id", draws=800).first()
    assert measure.poisson_interval(df.repartition(3), "dump", "id", draws=800, held=5_000).first()["low"] == pytest.approx(p["low"], abs=1e-9)
    tokens, ai = np.array([r[2] for r in rows], float), np.array([r[3] == "AI" for r in rows])
    low, high = measure.ratio_interval(tokens * ai, tokens, 0, 800)
    assert p["low"] == pytest.approx(low, abs=0.006) and p["high"] == pytest.approx(high, abs=0.006)


def test_unit_interval_is_that_of_resampling_units(spark):
    rng = random.Random(1)
    units = [(k, u, rng.randint(0, 5), rng.randint(1, 9)) for k in ("a", None) for u in range(1_500)]
    rows = [(k, u, v, w) for k, u, v, w in units for _ in range(1 + u % 3)]
    df = spark.createDataFrame(rows, "g string, u long, v int, w int").repartition(5)
    got = {r["g"]: r for r in measure.unit_interval(df, "g", "u", F.col("v"), F.col("w"), 100.0, draws=800).collect()}
    for k in ("a", None):
        v, w = (np.array([r[i] * (1 + r[1] % 3) for r in units if r[0] == k], float) for i in (2, 3))
        low, high = measure.ratio_interval(100 * v, w, 0, 800)
        assert got[k]["rate"] == pytest.approx(100 * v.sum() / w.sum()) and got[k]["units"] == 1_500
        assert got[k]["low"] == pytest.approx(low, abs=0.6) and got[k]["high"] == pytest.approx(high, abs=0.6)


def test_order_statistics(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(9)])) for k in "ab" for _ in range(57)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: r for r in measure.order_statistics(df, ["g"], "v", {"middle": F.floor(F.col("rows") / 2), "last": F.col("rows") - 1}).collect()}
    for k in "ab":
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert (got[k]["rows"], got[k]["middle"], got[k]["last"]) == (len(v), v[len(v) // 2], v[-1])


def test_packed_rows_against_a_loop(spark):
    docs = [(r["doc_id"], r["n_chars"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "n_chars").collect()]
    df = spark.createDataFrame(docs, "id long, length long").withColumn("h", rank_hash("webloom-v1", "id")).withColumn("reader", mixture.reader_of("h", 16))
    streams = {}
    for r in df.orderBy("h").collect():
        streams.setdefault(r["reader"], []).append((r["id"], r["length"]))
    want = sorted((s, i, j, *p) for s, pieces in streams.items() for i, row in enumerate(mixture.best_fit(pieces, 2_048, 1_000, True)) for j, p in enumerate(row))
    got = sorted(tuple(r) for r in catalog.QUERIES["packed_rows"](spark, FOLDER).collect())
    assert got == want and len(streams) > 10
