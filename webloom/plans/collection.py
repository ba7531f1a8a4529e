"""Queries over collection, sidecars, release tables and token stores.

Stand-ins: a document's file is its id by 500s, its row the rest; orders by month stand for dated documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webloom.functions import text
from webloom.functions.hashing import rank_hash
from webloom.operators import budget, crawls, evalsets, measure, pools, relational, release, runs, sidecars, store
from webloom.plans.base import BASE, KEY, base, query, read, read_in_order
from webloom.session import shared_root
from webloom.sources import row_groups

PLACED = BASE + ", p AS (SELECT *, 'part-' || CAST(id // 500 AS VARCHAR) AS file_name, id % 500 AS row_index, id % 500 // 50 AS block, sha256('row-blocks:7:' || dump || '/part-' || CAST(id // 500 AS VARCHAR) || '#' || CAST(id % 500 // 50 AS VARCHAR)) AS block_hash FROM base)\n"


def placed(spark, sf, **options):
    """base and the place of each row: file_name, row_index."""
    return base(spark, sf, **options).withColumns({"file_name": F.concat(F.lit("part-"), F.floor(F.col("id") / 500).cast("string")), "row_index": (F.col("id") % 500).cast("long")})


@query(PLACED + "SELECT id, block, block_hash FROM p")
def block_order(spark, sf):
    return crawls.in_block_order(placed(spark, sf), 7, 50).select("id", "block", "block_hash")


@query(PLACED + ", s AS (SELECT block_hash, count(*) FILTER (WHERE lang = 'en') AS n FROM p GROUP BY block_hash), c AS (SELECT block_hash, coalesce(sum(n) OVER (ORDER BY block_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT id FROM p JOIN c USING (block_hash) WHERE before < 60")
def blocks_until_enough(spark, sf):
    """Whole blocks in seeded order until 60 English documents are read."""
    return crawls.until_enough(crawls.in_block_order(placed(spark, sf), 7, 50), F.col("lang") == "en", 60).select("id")


GROUPS = """WITH p AS (SELECT doc_id AS id, lang, sha256('row-blocks:7:corpus/part-' || CAST(doc_id // 500 AS VARCHAR) || '#' || CAST((row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1) // 100 AS VARCHAR)) AS block_hash FROM documents),
s AS (SELECT block_hash, count(*) FILTER (WHERE lang = 'en') AS n FROM p GROUP BY block_hash), c AS (SELECT block_hash, coalesce(sum(n) OVER (ORDER BY block_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
"""


@query(GROUPS + "SELECT id, lang FROM p JOIN c USING (block_hash) WHERE before < 150")
def row_groups_until_enough(spark, sf):
    """Documents in files of 500 ids with row groups of 100: whole row groups in seeded order until 150 English documents are read; the others are not opened."""
    folder = f"{shared_root(spark)}/groups-{uuid.uuid4().hex}"
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.concat(F.lit("part-"), F.floor(F.col("doc_id") / 500).cast("string")).alias("file"))
    docs.repartition("file").sortWithinPartitions("file", "id").write.partitionBy("file").option("parquet.block.row.count.limit", 100).parquet(folder)
    groups = row_groups.row_groups(spark, {"corpus": folder}).withColumn("file_name", F.regexp_extract("file_path", "/file=([^/]+)/", 1))
    return crawls.row_groups_until_enough(groups, 7, "id bigint, lang string", F.col("lang") == "en", "lang string", 150).select("id", "lang")


@query(PLACED + "SELECT id, dump FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY dump ORDER BY block_hash, row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) WHERE before < 20000")
def collected_documents(spark, sf):
    return crawls.collected(placed(spark, sf).select("id", "dump", "tokens", "file_name", "row_index"), 7, 50, 20_000).select("id", "dump")


@query("WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS month FROM orders) SELECT month, id, h FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY h, id) AS n FROM (SELECT *, sha256('monthly/' || month || ':' || CAST(id AS VARCHAR)) AS h FROM o)) WHERE n <= 20")
def monthly_samples(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return crawls.month_samples(o, 20, "monthly").select("month", "id", "h")


@query("WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS date FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03') SELECT id, sha256('m/1996-03:' || CAST(id AS VARCHAR)) AS h FROM o ORDER BY h, id LIMIT 10")
def month_sample(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("string").alias("date"))
    return crawls.month_sample(o, "1996-03", 10, "m").select("id", "h")


def _topics(spark, sf):
    return placed(spark, sf).select("id", "file_name", "row_index", F.col("lang").alias("topic"), F.when(F.col("tokens") < 1_000, "short").otherwise("long").alias("format"))


@query(PLACED + "SELECT id, dump, label AS labels_label, lang AS topics_topic, CASE WHEN tokens < 1000 THEN 'short' ELSE 'long' END AS topics_format FROM p")
def documents_with_sidecars(spark, sf):
    """Documents and two sidecars laid out by file name, joined where they lie."""
    docs = sidecars.laid_out_by_file(placed(spark, sf))
    labels = sidecars.laid_out_by_file(docs.select("id", "file_name", "row_index", "label"))
    topics = sidecars.laid_out_by_file(_topics(spark, sf))
    return sidecars.joined(docs.select("id", "dump", "file_name", "row_index"), {"labels": labels, "topics": topics}).drop("file_name", "row_index")


@query(PLACED + "SELECT file_name AS month, string_agg(DISTINCT dump, ';' ORDER BY dump) AS dumps, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE label = 'AI') AS ai_documents, CAST(coalesce(sum(tokens) FILTER (WHERE label = 'AI'), 0) AS BIGINT) AS ai_tokens, round(coalesce(sum(tokens) FILTER (WHERE label = 'AI'), 0) / sum(tokens), 9) AS ai_share FROM p WHERE label IS NOT NULL GROUP BY file_name")
def share_of_month_files(spark, sf):
    """Label shares of files of documents, labels coming from their sidecars."""
    docs = placed(spark, sf)
    lying = sidecars.laid_out_by_file(docs)
    found = measure.share_of_files(lying.select("id", "dump", "tokens", "file_name", "row_index"), lying.select("id", "file_name", "row_index", "label"), draws=50)
    return found.select("month", "dumps", "documents", "tokens", "ai_documents", "ai_tokens", F.round("ai_share", 9).alias("ai_share"))


@query(PLACED + "SELECT id, dump, label, lang AS topic, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS token_count, true AS pii_anonymized FROM p")
def released_month_labels(spark, sf):
    """The monthly sample's release without its texts: labels and topics by place, personal data replaced where it never was."""
    docs = sidecars.laid_out_by_file(placed(spark, sf, text=True).withColumns({"token_count": text.white_words(F.col("text")), "pii_anonymized": F.col("id") % 3 == 0}))
    labels, topics = (sidecars.laid_out_by_file(docs.select("id", "file_name", "row_index", F.col(a).alias(b))) for a, b in (("label", "label"), ("lang", "topic")))
    columns = "id bigint, text string, dump string, label_label string, topics_topic string, token_count bigint, pii_anonymized boolean"
    found = release.released_months(docs.select("id", "text", "dump", "file_name", "row_index", "token_count", "pii_anonymized"), labels, topics, columns)
    found = relational.conform(found, release.release_schema(columns, with_text=False))
    return found.select("id", "dump", F.col("label_label").alias("label"), F.col("topics_topic").alias("topic"), "token_count", "pii_anonymized")


@query("""WITH c AS (SELECT doc_id AS id, text, lang, coalesce(sum(len(text)) OVER (ORDER BY doc_id // 500, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE len(text) >= 200), s AS (SELECT * FROM c WHERE before < 100000)
SELECT 'head' AS name, CAST(count(*) AS BIGINT) AS documents, CAST(sum(len(text)) AS BIGINT) AS characters, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS english FROM s""")
def evaluation_set(spark, sf):
    """The manifest of a set of the first 100,000 characters of a stream, in documents of 200 or more, written with their languages as domains."""
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.format_string("part-%09d", F.floor(F.col("doc_id") / 500).cast("long")).alias("file"))
    docs.repartition("file").sortWithinPartitions("file", "id").write.partitionBy("file").option("parquet.block.row.count.limit", 50).parquet(folder)
    head = evalsets.stream_head(spark, folder, "text string, lang string", 100_000, 200)
    made = evalsets.write_set(head, f"{folder}-sets", "head", source="documents", selection="first 100,000 characters", order=["place", "row_index"], domain_col="lang")
    return made.select("name", "documents", "characters", "tokens", F.coalesce(F.col("domains")["en"], F.lit(0).cast("long")).alias("english"))


@query(PLACED + "SELECT id FROM p WHERE (id // 500) % 2 = 1")
def unlabelled_shards(spark, sf):
    """Documents of the shards that have no sidecar yet, where those of even number have one."""
    docs = placed(spark, sf)
    return sidecars.shards_to_do(docs, docs.where("floor(id / 500) % 2 = 0")).select("id")


@query("SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN CASE WHEN value > 50 THEN 'AI' ELSE 'Human' END END AS label, CASE WHEN event_type = 'error' THEN 'error' END AS error FROM events")
def label_rows(spark, sf):
    e = read(spark, sf, "events")
    row = sidecars.label_row(F.when(F.col("event_type") == "error", "error").otherwise("success"), F.lit("4"), "4", F.when(F.col("value") > 50, "AI").otherwise("Human"), ("AI", "Human", "Mixed"), F.lit(None).cast("string"))
    return e.select(F.col("event_id").alias("id"), row.alias("r")).select("id", "r.label", "r.error")


RELEASED = "id bigint, text string, dump string, topics_topic string, topics_format string, token_count bigint, pii_anonymized boolean, label string"


@query(PLACED + "SELECT id, dump, lang AS topics_topic, CASE WHEN tokens < 1000 THEN 'short' ELSE 'long' END AS topics_format, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS token_count, true AS pii_anonymized, label FROM p WHERE label IS NOT NULL")
def release_labels(spark, sf):
    """The text-less table of all pools; replacing personal data leaves the number of words as it is."""
    docs, topics, out = placed(spark, sf, text=True), _topics(spark, sf), None
    docs = docs.withColumns({"token_count": text.white_words(F.col("text")), "pii_anonymized": F.col("id") % 3 == 0})
    for pool, label in release.POOL_LABELS.items():
        part = release.released_pool(docs.where(F.col("label") == label).drop("label"), pool, topics, RELEASED)
        part = relational.conform(part, release.release_schema(RELEASED, with_text=False))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def released_audit(spark, sf):
    """The audit's release table: stages by place, words counted, personal data replaced."""
    docs = placed(spark, sf, text=True)
    stages = docs.select("id", "file_name", "row_index", (F.col("lang") == "en").alias("english"))
    out = release.released_audit(docs.select("id", "text", "lang", "file_name", "row_index"), stages, "id bigint, text string, token_count bigint, source string, truncated boolean, pii_anonymized boolean, stage_english boolean")
    return out.withColumn("text", F.sha2("text", 256))


STORE = BASE + ", k AS (SELECT id, substr(h, 1, 16) AS key, string_split(text, ' ') AS w FROM base WHERE substr(h, 1, 16) < '8000000000000000'), i AS (SELECT id, key, w, CAST(len(w) AS BIGINT) AS length, CAST(coalesce(sum(len(w)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k)\n"


def _store(spark, sf):
    docs = base(spark, sf, text=True).select("id", "text", F.substring("h", 1, 16).alias("h"))
    folder = f"{shared_root(spark)}/store-{uuid.uuid4().hex}"
    return folder, store.build_store(docs, folder, lambda t: F.transform(F.split(t, " "), lambda w: F.char_length(w)), share=0.5)


@query(STORE + "SELECT id, key, start AS \"offset\", length FROM i")
def token_store(spark, sf):
    """Index of a store of the lower half of the keys; a word's token is its length."""
    return _store(spark, sf)[1].select("id", "key", "offset", "length")


@query(STORE + "SELECT key, list_transform(w[greatest(1000 - start, 0) + 1:least(9000 - start, length)], lambda x: CAST(length(x) AS INT)) AS tokens FROM i WHERE start < 9000 AND start + length > 1000")
def store_range(spark, sf):
    return store.read_tokens(spark, _store(spark, sf)[0], 1_000, 9_000)


CANDIDATES = "WITH c AS (SELECT l_orderkey AS id, l_linenumber AS ordinal, CAST(l_quantity AS BIGINT) AS tokens, CASE l_returnflag WHEN 'A' THEN 'AI' WHEN 'R' THEN 'Human' END AS label, CASE WHEN l_orderkey % 5 = 0 THEN 'natural' ELSE 'editlens_ai' END AS selection FROM lineitem), f AS (SELECT *, CASE WHEN label IS NULL THEN CASE WHEN selection = 'natural' THEN '_unlabeled_natural' ELSE '_unlabeled' END WHEN selection = 'natural' THEN 'natural' ELSE lower(label) END AS pool FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS n FROM c) WHERE n = 1)\n"


@query(CANDIDATES + "SELECT pool, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY pool UNION ALL SELECT '_duplicates', (SELECT count(*) - count(DISTINCT id) FROM c), NULL UNION ALL SELECT '_left_out', (SELECT count(DISTINCT id) FROM c) - (SELECT count(*) FROM f WHERE pool IS NOT NULL), NULL")
def pool_statistics_with_duplicates(spark, sf):
    """Lines of an order with one number stand in the order of the table."""
    items = read_in_order(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "__file", "__row").alias("ordinal"), F.col("l_quantity").cast("long").alias("tokens"), F.when(F.col("l_returnflag") == "A", "AI").when(F.col("l_returnflag") == "R", "Human").alias("label"), F.when(F.col("l_orderkey") % 5 == 0, "natural").otherwise("editlens_ai").alias("selection"))
    return pools.pool_stats_of(items)


@query(BASE + ", f AS (SELECT * FROM base WHERE label IS NOT NULL), t AS (SELECT id, label, tokens FROM (SELECT *, coalesce(sum(tokens) OVER (ORDER BY h DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f) WHERE prior < 100000) SELECT 'all' AS part, id FROM t UNION ALL SELECT lower(label), id FROM t WHERE label IN ('Human', 'AI')")
def held_out_parts(spark, sf):
    docs = base(spark, sf).where("label is not null")
    parts, out = pools.by_label(pools.held_out_tail(docs, docs.where("false"), 100_000)), None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("part"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p.page_id, m.url FROM (SELECT page_id, split_part(url, '/', -1) AS base_name FROM pages) p JOIN (SELECT split_part(url, '/', -1) AS base_name, min(url) AS url FROM pages GROUP BY 1) m USING (base_name)")
def full_paths(spark, sf):
    """The full path of each page's file name, by a table of them."""
    p = read(spark, sf, "pages").select("page_id", "url")
    return relational.full_path(p.select("page_id", text.base_name(F.col("url")).alias("base_name")), p.select("url"), "base_name", "url").select("page_id", "url")


DATED = "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS topic, o_orderstatus AS format, CAST(round(o_totalprice) AS BIGINT) AS tokens, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'AI' WHEN o_custkey % 3 = 1 THEN 'Human' ELSE 'Mixed' END AS label FROM orders)\n"


def dated(spark, sf):
    return read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("format"), F.round("o_totalprice").cast("long").alias("tokens"), F.when(F.col("o_custkey") % 7 == 0, None).when(F.col("o_custkey") % 3 == 0, "AI").when(F.col("o_custkey") % 3 == 1, "Human").otherwise("Mixed").alias("label"))


@query(DATED + "SELECT period, topic, format, label, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM o WHERE label IS NOT NULL GROUP BY ALL")
def topic_format_cube(spark, sf):
    return measure.cube(dated(spark, sf), ["period", "topic", "format", "label"])


QUARTERS = DATED + ", q AS (SELECT substr(period, 1, 4) || 'Q' || CAST((CAST(substr(period, 6, 2) AS INT) + 2) // 3 AS VARCHAR) AS quarter, topic, CAST(count(*) AS BIGINT) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN label = 'AI' THEN tokens ELSE 0 END) AS BIGINT) AS ai_tokens FROM o WHERE label IS NOT NULL GROUP BY 1, 2)\n"


def _quarters(spark, sf):
    rows = dated(spark, sf).where("label is not null").withColumn("quarter", text.quarter_of(F.col("period")))
    return measure.quarter_shares(rows, "topic")


@query(QUARTERS + "SELECT quarter, topic, documents, tokens, ai_tokens, round(100.0 * tokens / sum(tokens) OVER (PARTITION BY quarter), 9) AS share, round(100.0 * ai_tokens / tokens, 9) AS ai_share FROM q")
def quarter_rollup(spark, sf):
    return _quarters(spark, sf).withColumns({c: F.round(c, 9) for c in ("share", "ai_share")})


@query(QUARTERS + ", l AS (SELECT topic, documents, tokens, ai_tokens / tokens AS ai FROM q WHERE quarter = (SELECT max(quarter) FROM q)), a AS (SELECT topic, 1 AS part, row_number() OVER (ORDER BY tokens DESC, topic) AS n FROM l), b AS (SELECT topic, 2 AS part, row_number() OVER (ORDER BY ai DESC, topic) AS n FROM l WHERE documents >= 2), u AS (SELECT topic, min(part * 100 + n) AS k FROM (SELECT * FROM a WHERE n <= 2 UNION ALL SELECT * FROM b WHERE n <= 2) GROUP BY topic) SELECT topic, CAST(row_number() OVER (ORDER BY k) AS INT) AS place FROM u")
def trend_highlights(spark, sf):
    q = _quarters(spark, sf)
    last = q.join(q.agg(F.max("quarter").alias("quarter")), "quarter")
    return runs.highlights(last, "topic", "tokens", "ai_share", "documents", 2, 2, 2)


@query(DATED + ", c AS (SELECT topic, format, count(*) AS documents, count(*) FILTER (WHERE label = 'AI') AS ai FROM o WHERE label IS NOT NULL GROUP BY ALL), p AS (SELECT *, CASE WHEN documents >= 5 THEN 100.0 * ai / documents END AS percent FROM c), t AS (SELECT topic, row_number() OVER (ORDER BY sum(ai) / sum(documents) DESC, topic) AS topic_place FROM c GROUP BY topic), f AS (SELECT format, row_number() OVER (ORDER BY sum(ai) / sum(documents) DESC, format) AS format_place FROM c GROUP BY format) SELECT topic, format, documents, round(percent, 9) AS percent, round(least(1.0, percent / (SELECT quantile_cont(percent, 0.98) FROM p)), 9) AS shade, CAST(topic_place AS INT) AS topic_place, CAST(format_place AS INT) AS format_place FROM p JOIN t USING (topic) JOIN f USING (format)")
def heat_map_cells(spark, sf):
    counts = dated(spark, sf).where("label is not null").groupBy("topic", "format").agg(F.count("*").alias("documents"), F.count(F.when(F.col("label") == "AI", 1)).alias("ai"))
    return runs.heat_cells(counts, "topic", "format", 5).withColumns({c: F.round(c, 9) for c in ("percent", "shade")})


@query(DATED + "SELECT period, topic, tokens FROM o WHERE topic IS NOT NULL AND topic <> '5-LOW' AND label IS NOT NULL")
def labelled_topics(spark, sf):
    return measure.labelled_only(measure.labelled_only(dated(spark, sf), ["topic"], "5-LOW"), ["label"]).select("period", "topic", "tokens")


@query(BASE + "SELECT id, (row_number() OVER (ORDER BY tokens, id) - 1) // 16 AS batch FROM base")
def length_batches(spark, sf):
    return measure.length_batches(base(spark, sf).select("id", "tokens"), "tokens", 16, "id").select("id", "batch")


@query(BASE + ", d AS (SELECT lang, round(sum(CASE WHEN tokens % 9 <> 0 THEN ln(1 + tokens) * tokens END) / (ln(2) * sum(CASE WHEN tokens % 9 = 0 THEN 0 ELSE tokens END)), 9) AS bpb, count(DISTINCT id) AS docs, count(*) AS windows, CAST(sum(CASE WHEN tokens % 9 = 0 THEN 0 ELSE tokens END) AS BIGINT) AS bytes FROM base GROUP BY lang) SELECT * FROM d")
def domain_scores(spark, sf):
    rows = base(spark, sf).select("lang", F.col("id").alias("doc_id"), F.when(F.col("tokens") % 9 == 0, 0).otherwise(F.col("tokens")).cast("long").alias("bytes"), (F.log1p("tokens") * F.col("tokens")).alias("nats"))
    return measure.domain_scores(rows, ["lang"]).withColumn("bpb", F.round("bpb", 9)).drop("nats")


@query()
def phrase_interval(spark, sf):
    """Typical phrases per 1,000 words of each role, conversations resampled."""
    turns = read(spark, sf, "conversations")
    found = measure.unit_interval(turns, "role", "conv_id", text.phrase_hits(F.col("text")), text.letter_words(F.col("text")), 1_000.0)
    return found.withColumns({c: F.round(c, 9) for c in ("rate", "low", "high")})


@query()
def label_share_interval(spark, sf):
    """Percent of conversations whose first answer is labelled AI (here: is of even length), with its interval."""
    first = read(spark, sf, "conversations").where("turn = 1").withColumn("set", F.lit("sample 0"))
    found = measure.unit_interval(first, "set", "conv_id", (F.char_length("text") % 2 == 0).cast("int"), F.lit(1), 100.0)
    return found.withColumns({c: F.round(c, 9) for c in ("rate", "low", "high")})


@query(BASE + "SELECT id, 'editlens_ai' AS selection, CAST(NULL AS VARCHAR) AS pangram_label, label FROM base")
def shaped_candidates(spark, sf):
    return pools.shaped_candidates(base(spark, sf).select("id", "label"), "editlens_ai", {"pangram_label": "string", "label": "string"}).select("id", "selection", "pangram_label", "label")


@query(BASE + ", r AS (SELECT id, dump, tokens, h, CAST(row_number() OVER (PARTITION BY dump ORDER BY h, id) AS BIGINT) AS n FROM base) SELECT id, dump, n, sha256('" + KEY + ":' || CAST(id AS VARCHAR)) AS h FROM r WHERE n <= 7")
def keyed_set_order(spark, sf):
    """The first seven documents of each dump's evaluation set in hash order, with their places."""
    ranked = budget.running_total(base(spark, sf).select("id", "dump", "h"), "h", F.lit(1), by=["dump"], name="n").withColumn("n", F.col("n") + 1)
    return ranked.where("n <= 7").select("id", "dump", "n", rank_hash(KEY, "id").alias("h"))
