"""Queries that write tables in the engine's formats and read them again: the twins see the tables alone, so they hold the whole way there and back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webloom.functions import tokens
from webloom.functions.hashing import rank_hash, training_order
from webloom.operators import documents
from webloom.plans.base import KEY, query, read
from webloom.session import shared_root
from webloom.sources import tables


def _folder(spark, name):
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, n_chars, md5(text) AS digest FROM documents")
def json_lines_documents(spark, sf):
    """Documents through gzipped JSON lines."""
    path = _folder(spark, "lines")
    tables.write_json_lines(read(spark, sf, "documents"), path)
    return tables.json_lines(spark, path, "doc_id bigint, text string, lang string, n_chars bigint").select("doc_id", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def csv_records(spark, sf):
    """The parts of the first brand from a typed CSV table of all."""
    part, path = read(spark, sf, "part"), _folder(spark, "csv")
    tables.write_csv(part, path)
    first = part.agg(F.min("p_brand")).first()[0]
    return tables.records(spark, path, part.schema, p_brand=first).select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // 64 AS shard FROM documents")
def ordered_shards(spark, sf):
    """Documents written in an order in shards of 64 rows: their places by the scan's file names and rows."""
    from webloom.operators.budget import running_total, running_total_in_order

    path = _folder(spark, "shards")
    docs = read(spark, sf, "documents").withColumn("key", F.md5(F.col("doc_id").cast("string").cast("binary")))
    tables.write_shards(running_total(docs, "key", F.lit(1), ties=("doc_id",), name="n"), path, "n", rows_per_shard=64)
    names = {name: i for i, name in enumerate(tables.shard_names(spark, path))}
    shards = spark.createDataFrame(list(names.items()), "file_name string, shard long")
    scanned = tables.ordered_scan(spark, path, ["doc_id"]).join(F.broadcast(shards), "file_name")  # a row a file
    return running_total_in_order(scanned, ["file_name", "row_index"], F.lit(1), name="place").select("doc_id", "place", "shard")


@query("SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY source, lang")
def nested_documents(spark, sf):
    """Documents in folders by source and language, found again below their root."""
    path = _folder(spark, "nested")
    read(spark, sf, "documents").select("doc_id", "n_chars", F.col("source").alias("s"), F.col("lang").alias("l")).write.partitionBy("s", "l").parquet(path)
    found = tables.recursive_scan(spark, path).select("n_chars", *[F.regexp_extract("file_path", f"/{k}=([^/]+)/", 1).alias(name) for k, name in (("s", "source"), ("l", "lang"))])
    return found.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").cast("long").alias("characters"))


@query("SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS \"set\", coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END, ''), lang) AS domain, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents WHERE text <> '' GROUP BY 1, 2")
def documents_of_sets(spark, sf):
    """Documents from two JSON-lines sources whose domain is the first of three fields that isn't empty."""
    docs = read(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("subdomain"), F.col("lang").alias("source"), "text", "lang")
    paths = {}
    for name, part in (("english", docs.where("lang = 'en'")), ("other", docs.where("lang is null or lang <> 'en'"))):
        paths[name] = _folder(spark, name)
        tables.write_json_lines(part.drop("lang"), paths[name])
    return tables.set_sources(spark, paths).groupBy("set", "domain").agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).cast("long").alias("characters"))


@query("SELECT url AS path, row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages")
def listed_urls(spark, sf):
    """The addresses of pages from a text file that lists them, with their places."""
    path = _folder(spark, "paths")
    read(spark, sf, "pages").orderBy("page_id").select("url").coalesce(1).write.text(path, compression="gzip")  # a list is one file
    return tables.path_list(spark, path).select("path", F.col("place").cast("long").alias("place"))


@query("""SELECT n_nationkey, json AS json FROM (SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || ',"share":' || CASE WHEN n_nationkey % 3 = 0 THEN 'null' ELSE '0.5' END || '}' AS json FROM nation)""")
def json_cells(spark, sf):
    """JSON texts of rows; what is no finite number is null in them."""
    share = F.when(F.col("n_nationkey") % 3 > 0, F.lit(0.5)).when(F.col("n_nationkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    rows = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), share.alias("share"), "n_nationkey")
    return tables.json_rows(rows.select("name", "region", "share")).withColumn("name", F.get_json_object("json", "$.name")).join(rows.select("name", "n_nationkey"), "name").select("n_nationkey", "json")


#: splitmix64 in 128-bit arithmetic, kept to 64 bits.
_WRAP = "CAST(18446744073709551616 AS UHUGEINT)"


def _mixed(x: str) -> str:
    z = f"(({x}) + CAST(11400714819323198485 AS UHUGEINT)) % {_WRAP}"
    for shift, factor in ((30, "13787848793156543929"), (27, "10723151780598845931")):
        z = f"(SELECT (xor(z, z >> {shift}) * CAST({factor} AS UHUGEINT)) % {_WRAP} FROM (SELECT {z} AS z))"
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {z} AS z))"


@query(f"""WITH k AS (SELECT doc_id AS id, CAST(CAST('0x' || substr(sha256('{KEY}:' || CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) AS UHUGEINT) AS h FROM documents),
s AS (SELECT e AS epoch, xor({_mixed("CAST(1337 AS UHUGEINT)")}, CAST(e AS UHUGEINT)) AS seeded FROM range(2) t(e)), salts AS (SELECT epoch, {_mixed("seeded")} AS salt FROM s),
x AS (SELECT id, epoch, xor(h, salt) AS x FROM k, salts)
SELECT id, epoch, lower(lpad(hex(CAST({_mixed("x")} AS UBIGINT)), 16, '0')) AS order_key FROM x""")
def training_order_keys(spark, sf):
    """Where documents stand in two passes over the data."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring(rank_hash(KEY, "doc_id"), 1, 16).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"))
    return docs.select("id", "epoch", training_order("h", 1337, F.col("epoch"), spark).alias("order_key"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'crawl-data/CC-' || source || '/warc/' || source || '.warc.gz' AS warc_path, lang, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS token_count, length(text) AS n_chars FROM documents WHERE length(text) >= 500 AND source <> (SELECT max(source) FROM documents)""")
def materialised_documents(spark, sf):
    """Documents of 500 characters or more from JSON lines, with the listed paths of their files; one file has none."""
    docs, path = read(spark, sf, "documents"), _folder(spark, "extracted")
    tables.write_json_lines(docs.select(F.col("doc_id").alias("id"), "text", "lang", F.concat("source", F.lit(".warc.gz")).alias("file_name")), path)
    sources = docs.select("source").distinct()
    last = docs.agg(F.max("source")).first()[0]
    paths = sources.where(F.col("source") != last).select(F.concat(F.lit("crawl-data/CC-"), "source", F.lit("/warc/"), "source", F.lit(".warc.gz")).alias("warc_path"))
    extracted = tables.json_lines(spark, path, "id bigint, text string, lang string, file_name string")
    found = documents.documents_of(extracted, paths, "id string, warc_path string, lang string, token_count bigint, text string", min_chars=500)
    return found.select("id", "warc_path", "lang", "token_count", F.char_length("text").alias("n_chars"))


def _vocabulary() -> str | None:
    """The file of a public byte-level vocabulary, where this machine has one."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return None
    return public_tokenizers.path("byte_bpe_50k.json")


if _vocabulary():

    @query()
    def bpe_token_counts(spark, sf):
        """Tokens of every document by a byte-level BPE vocabulary."""
        from webloom.session import ship

        ship(spark)
        return read(spark, sf, "documents").select("doc_id", tokens.bpe_tokens(F.col("text"), _vocabulary()).alias("tokens"))
