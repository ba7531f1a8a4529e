"""Queries over documents: normalising, sampling, budgets, pools, held-out sets, shares, survival."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.functions import pii, text
from webloom.functions.hashing import rank_hash
from webloom.operators import budget, filters, languages, measure, near_duplicates, pools, relational
from webloom.plans.base import BASE, KEY, base, query, read
from webloom.sources import tables, warc

SHARES = ", ".join(f"CAST(sum(CASE WHEN label = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x.lower()}_documents, CAST(sum(CASE WHEN label = '{x}' THEN tokens ELSE 0 END) AS BIGINT) AS {x.lower()}_tokens" for x in measure.LABELS)


@query(BASE + f"""SELECT dump, dump AS dumps, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, {SHARES},
  round(sum(CASE WHEN label = 'AI' THEN tokens ELSE 0 END) / sum(tokens), 9) AS ai_share,
  round(sum(CASE WHEN label <> 'Human' THEN tokens ELSE 0 END) / sum(tokens), 9) AS ai_or_mixed_share
FROM base WHERE label IS NOT NULL GROUP BY dump""")
def label_share_by_source(spark, sf):
    shares = measure.label_share(base(spark, sf).withColumn("d", F.col("dump")), "dump", "d")
    return shares.withColumns({c: F.round(c, 9) for c in ("ai_share", "ai_or_mixed_share")})


@query(f"""WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, event_id AS id, event_type, CAST(value AS BIGINT) AS tokens, CASE event_type WHEN 'click' THEN 'AI' WHEN 'purchase' THEN 'Mixed' ELSE 'Human' END AS label FROM events)
SELECT day, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS dumps, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, {SHARES},
  round(sum(CASE WHEN label = 'AI' THEN tokens ELSE 0 END) / sum(tokens), 9) AS ai_share, round(sum(CASE WHEN label <> 'Human' THEN tokens ELSE 0 END) / sum(tokens), 9) AS ai_or_mixed_share
FROM e GROUP BY day""")
def label_share_over_time(spark, sf):
    e = read(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("dump"), F.floor(F.col("value") + 0.5).cast("long").alias("rounded"), F.bround("value").cast("long").alias("tokens"), F.when(F.col("event_type") == "click", "AI").when(F.col("event_type") == "purchase", "Mixed").otherwise("Human").alias("label"))
    shares = measure.label_share(e, "day")
    return shares.withColumns({c: F.round(c, 9) for c in ("ai_share", "ai_or_mixed_share")})


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS dump, 'common_crawl' AS origin, CAST(n_chars AS BIGINT) AS token_count, false AS pii_anonymized FROM documents WHERE length(text) >= 200")
def normalised_documents(spark, sf):
    docs = read(spark, sf, "documents").where(F.char_length("text") >= 200)
    shaped = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("dump"), F.lit("common_crawl").alias("origin"), F.col("n_chars").alias("token_count"), F.lit(False).alias("pii_anonymized"), "lang")
    return relational.conform(shaped, "id string, dump string, origin string, token_count bigint, pii_anonymized boolean")


@query("SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://')) ELSE url END AS trimmed, split_part(url, '/', -1) AS base_name, url || chr(10) || chr(10) || html AS classifier_input FROM pages")
def page_paths(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", F.substring(text.crawl_path(F.replace("url", F.lit("://"), F.lit("crawl-data/"))), 1, 10_000).alias("t"), "url", "html").select(
        "page_id", F.replace("t", F.lit("crawl-data/"), F.lit("://")).alias("trimmed"), text.base_name(F.col("url")).alias("base_name"), text.classifier_input(F.col("url"), F.col("html")).alias("classifier_input"))


@query("SELECT page_id, url || chr(10) || chr(10) || html AS classifier_input FROM pages")
def page_classifier_inputs(spark, sf):
    """The classifier's input of ``page_paths``, with the whole page."""
    return read(spark, sf, "pages").select("page_id", text.classifier_input(F.col("url"), F.col("html")).alias("classifier_input"))


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT month, 7 + CAST(replace(month, '-', '') AS BIGINT) AS month_seed, CAST(substr(month, 1, 4) AS BIGINT) * 12 + CAST(substr(month, 6, 2) AS BIGINT) - 1 AS month_index, month AS back, substr(month, 1, 4) || 'Q' || CAST((CAST(substr(month, 6, 2) AS INT) + 2) // 3 AS VARCHAR) AS quarter, substr(month, 1, 4) AS crawl_year FROM m""")
def month_functions(spark, sf):
    m = read(spark, sf, "orders").select(text.month_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("month")).distinct()
    month = F.col("month")
    return m.select("month", text.month_seed(7, month).alias("month_seed"), text.month_index(month).alias("month_index"), text.month_label(text.month_index(month)).alias("back"), text.quarter_of(month).alias("quarter"), text.crawl_year(F.concat(F.lit("CC-MAIN-"), month)).alias("crawl_year"))


@query(BASE + "SELECT id, h FROM base ORDER BY h, id LIMIT 100")
def bottom_k_by_hash(spark, sf):
    return budget.bottom_k(base(spark, sf).select("id", "h"), "h", 100)


@query(BASE + "SELECT id, dump, h FROM (SELECT *, row_number() OVER (PARTITION BY dump ORDER BY h, id) AS n FROM base) WHERE n <= 5")
def bottom_k_per_dump(spark, sf):
    return budget.bottom_k_by(base(spark, sf).select("id", "dump", "h"), ["dump"], "h", 5)


@query(BASE + "SELECT id, dump, tokens FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY dump ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM base) WHERE prior < 20000")
def token_budget_prefix(spark, sf):
    return budget.fill_budget(base(spark, sf).select("id", "dump", "tokens", "h"), "h", "tokens", 20_000, by=["dump"]).select("id", "dump", "tokens")


@query(BASE + "SELECT id, tokens FROM (SELECT *, coalesce(sum(tokens) OVER (ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM base WHERE tokens >= 200) WHERE prior < 300000")
def char_budget_prefix(spark, sf):
    return budget.fill_budget(base(spark, sf).where("tokens >= 200").select("id", "tokens", "h"), "h", "tokens", 300_000).select("id", "tokens")


@query(BASE + ", t AS (SELECT dump, max(h) AS threshold FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY dump ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM base) WHERE prior < 15000 GROUP BY dump) SELECT b.id, b.dump, t.threshold FROM base b JOIN t USING (dump) WHERE b.h <= t.threshold")
def hash_threshold_per_dump(spark, sf):
    docs = base(spark, sf).select("id", "dump", "tokens", "h")
    limits = budget.hash_threshold(docs, "h", "tokens", 15_000, ["dump"])
    return docs.join(limits, "dump").where("h <= threshold").select("id", "dump", "threshold")


@query(BASE + "SELECT id, least(tokens, 250000 - prior) AS tokens FROM (SELECT *, CAST(coalesce(sum(tokens) OVER (ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM base) WHERE prior < 250000")
def exact_budget_cut(spark, sf):
    docs = base(spark, sf).select("id", "tokens", "h")
    return budget.fill_budget(budget.require_budget(docs, "tokens", 250_000), "h", "tokens", 250_000, trim=True).select("id", "tokens")


@query(BASE + ", n AS (SELECT *, row_number() OVER (ORDER BY h, id) AS k FROM base) SELECT id, least(tokens, 60000 - prior) AS tokens FROM (SELECT *, CAST(coalesce(sum(tokens) OVER (ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM n WHERE k > 40) WHERE prior < 60000")
def budget_from_offset(spark, sf):
    docs = base(spark, sf).select("id", "tokens", "h")
    later = budget.running_total(docs, "h", F.lit(1), name="row").where("row >= 40")
    return budget.fill_budget(later, "h", "tokens", 60_000, trim=True).select("id", "tokens")


@query(BASE + "SELECT id, CAST(coalesce(sum(tokens) OVER (ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM base")
def store_offsets(spark, sf):
    return budget.running_total(base(spark, sf).select("id", "tokens", "h"), "h", F.col("tokens"), name="start").select("id", "start")


@query("SELECT doc_id AS id, source, k FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, 1 AS k FROM documents) WHERE n = 1")
def first_occurrences(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("digest"))
    return relational.first_occurrence(docs, ["digest"], ["id"]).select("id", "source", F.lit(1).alias("k"))


BUCKETED = BASE + ", b AS (SELECT *, id % 4 AS bucket FROM base)"
PRESELECT = BUCKETED + """, t AS (SELECT dump, sum(CASE WHEN bucket >= 2 THEN tokens ELSE 0 END) AS ai, sum(CASE WHEN bucket = 0 THEN tokens ELSE 0 END) AS avail FROM b GROUP BY dump),
q AS (SELECT dump, least(avail, CAST(round_even(CAST(200000 * ai AS DOUBLE) / (SELECT sum(ai) FROM t), 0) AS BIGINT)) AS quota FROM t),
s AS (SELECT b.*, coalesce(sum(tokens) OVER (PARTITION BY dump ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM b WHERE bucket = 0)
"""


@query(PRESELECT + "SELECT id, dump, 'editlens_human' AS selection FROM s JOIN q USING (dump) WHERE prior < quota UNION ALL SELECT id, dump, 'editlens_ai' FROM b WHERE bucket >= 2")
def preselected_documents(spark, sf):
    docs = base(spark, sf).withColumn("bucket", F.col("id") % 4)
    return pools.preselect(docs, 200_000).select("id", "dump", "selection")


@query(BASE + "SELECT id, 'natural' AS selection FROM (SELECT id, row_number() OVER (ORDER BY h, id) AS n FROM base) WHERE n <= 150")
def natural_draw(spark, sf):
    return pools.natural_draw(base(spark, sf).select("id", "h"), 150).select("id", "selection")


CANDIDATES = BASE + """, c AS (SELECT id, dump, tokens, label, h, CASE WHEN id % 5 = 0 THEN 'natural' ELSE 'editlens_ai' END AS selection, id AS ordinal FROM base
  UNION ALL SELECT id, dump, tokens, label, h, 'editlens_ai', id + 1000000 FROM base WHERE id % 10 = 1),
p AS (SELECT *, CASE WHEN label IS NULL THEN CASE WHEN selection = 'natural' THEN '_unlabeled_natural' ELSE '_unlabeled' END WHEN selection = 'natural' THEN CASE WHEN label IN ('Human', 'AI') THEN 'natural' END ELSE lower(label) END AS pool
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS n FROM c) WHERE n = 1)
"""


def _pools(spark, sf):
    docs = base(spark, sf)
    first = docs.withColumns({"selection": F.when(F.col("id") % 5 == 0, "natural").otherwise("editlens_ai"), "ordinal": F.col("id")})
    again = docs.where("id % 10 = 1").withColumns({"selection": F.lit("editlens_ai"), "ordinal": F.col("id") + 1_000_000})
    return pools.build_pools(first.unionByName(again))


@query(CANDIDATES + "SELECT id, pool, h FROM p WHERE pool IS NOT NULL")
def label_pools(spark, sf):
    return pools.sorted_pools(_pools(spark, sf).select("id", "pool", "h"))


@query(CANDIDATES + "SELECT pool, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM p WHERE pool IS NOT NULL GROUP BY pool")
def pool_statistics(spark, sf):
    return pools.pool_stats(_pools(spark, sf))


@query(BASE + """, f AS (SELECT * FROM base WHERE label IS NOT NULL AND id % 3 <> 0)
SELECT id, label, tokens FROM (SELECT *, coalesce(sum(tokens) OVER (ORDER BY h DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f) WHERE prior < 100000""")
def held_out_tail(spark, sf):
    docs = base(spark, sf)
    return pools.held_out_tail(docs.where("label is not null"), docs.where("id % 3 = 0"), 100_000).select("id", "label", "tokens")


@query(BASE + ", n AS (SELECT DISTINCT dump AS name FROM base), k AS (SELECT name, row_number() OVER (ORDER BY name) AS r, count(*) OVER () AS n FROM n) SELECT name, CAST(100003 // n + CASE WHEN r <= 100003 % n THEN 1 ELSE 0 END AS BIGINT) AS budget FROM k")
def equal_budgets(spark, sf):
    return budget.equal_budgets(base(spark, sf).select(F.col("dump").alias("name")), 100_003)


@query(BASE + """, n AS (SELECT DISTINCT dump AS name FROM base), k AS (SELECT name, row_number() OVER (ORDER BY name) AS r, count(*) OVER () AS n FROM n), q AS (SELECT name AS dump, 100003 // n + CASE WHEN r <= 100003 % n THEN 1 ELSE 0 END AS quota FROM k)
SELECT id, dump, tokens FROM (SELECT base.*, quota, coalesce(sum(tokens) OVER (PARTITION BY dump ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM base JOIN q USING (dump)) WHERE prior < quota""")
def year_sample(spark, sf):
    docs = base(spark, sf).select("id", "dump", "tokens", "h")
    wanted = budget.equal_budgets(docs.select(F.col("dump").alias("name")), 100_003).select(F.col("name").alias("dump"), F.col("budget").alias("quota"))
    return budget.fill_budget(docs.join(wanted, "dump"), "h", "tokens", F.col("quota"), by=["dump"]).select("id", "dump", "tokens")


@query(BASE + "SELECT dump, lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(tokens) AS BIGINT) AS tokens FROM base GROUP BY dump, lang")
def set_manifest(spark, sf):
    return pools.manifest(base(spark, sf, text=True), ["dump", "lang"])


@query(BASE + "SELECT dump, lang, label, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM base WHERE label IS NOT NULL GROUP BY dump, lang, label")
def label_cube(spark, sf):
    return measure.cube(base(spark, sf), ["dump", "lang", "label"])


@query(BASE + "SELECT coalesce(dump, 'all') AS dump, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM base GROUP BY GROUPING SETS ((dump), ())")
def composition(spark, sf):
    return base(spark, sf).rollup("dump").agg(F.count("*").alias("documents"), F.sum("tokens").cast("long").alias("tokens")).withColumn("dump", F.coalesce("dump", F.lit("all")))


SURVIVAL = "s1 AND s2 AND s3"


@query(BASE + """, f AS (SELECT label, lang = 'en' AS s1, tokens >= 400 AS s2, tokens % 7 <> 0 AS s3 FROM base),
a AS (SELECT label, 0 AS number, 'sample' AS stage, true AS alive FROM f UNION ALL SELECT label, 1, 's1', s1 FROM f UNION ALL SELECT label, 2, 's2', s1 AND s2 FROM f UNION ALL SELECT label, 3, 's3', s1 AND s2 AND s3 FROM f)
SELECT number, stage, CAST(sum(CASE WHEN alive THEN 1 ELSE 0 END) AS BIGINT) AS kept, """ + ", ".join(f"round(100.0 * sum(CASE WHEN alive AND label = '{x}' THEN 1 ELSE 0 END) / sum(CASE WHEN label = '{x}' THEN 1 ELSE 0 END), 9) AS {x.lower()}" for x in measure.LABELS) + " FROM a GROUP BY number, stage")
def filter_survival(spark, sf):
    flags = base(spark, sf).select("label", (F.col("lang") == "en").alias("s1"), (F.col("tokens") >= 400).alias("s2"), (F.col("tokens") % 7 != 0).alias("s3"))
    return measure.survival(flags, ["s1", "s2", "s3"]).withColumns({x.lower(): F.round(x.lower(), 9) for x in measure.LABELS})


@query()
def filter_audit(spark, sf):
    """Every document's cumulative flags, first failing stage and the length of its edited text."""
    docs = read(spark, sf, "documents")
    return filters.audit(docs).select("doc_id", *filters.STAGES, "removed_at", F.char_length("edited").alias("edited_chars"))


@query()
def language_scores(spark, sf):
    """The language that a letter model fitted on the documents finds in each of them."""
    docs = read(spark, sf, "documents")
    found = languages.with_language(docs.select("doc_id", "text"), languages.fit(docs))
    return found.select("doc_id", "language.lang", F.round("language.score", 6).alias("score"))


@query()
def scored_filter_audit(spark, sf):
    """As ``filter_audit``, the language taken from the text instead of a column."""
    docs = read(spark, sf, "documents")
    return filters.audit(docs.drop("lang"), model=languages.fit(docs)).select("doc_id", *filters.STAGES, "removed_at")


@query()
def filtered_survival(spark, sf):
    docs = filters.audit(base(spark, sf, text=True))
    return measure.survival(docs.select("label", *filters.STAGES), list(filters.STAGES))


@query()
def near_duplicate_groups(spark, sf):
    """Root of each document's near-duplicate cluster within its language."""
    return near_duplicates.near_duplicate_groups(read(spark, sf, "documents"), id_col="doc_id", by="lang")


@query("SELECT min(doc_id) AS doc_id, source FROM (SELECT doc_id, text, first_value(source) OVER (PARTITION BY text ORDER BY doc_id) AS source FROM documents) GROUP BY text, source")
def exact_deduplication(spark, sf):
    return near_duplicates.drop_exact_duplicates(read(spark, sf, "documents"), id_col="doc_id").select("doc_id", "source")


@query()
def anonymised_documents(spark, sf):
    """doc_id, how many characters and tokens remain after e-mail and public IP addresses are replaced."""
    docs = read(spark, sf, "documents").select("doc_id", "text", text.white_words(F.col("text")).alias("token_count"))
    done = pii.anonymise_rows(docs, F.lit(True))
    return done.select("doc_id", "token_count", F.sha2("text", 256).alias("digest"), "pii_anonymized")


@query("SELECT url, strlen(html) AS bytes, md5(html) AS digest FROM pages")
def warc_records(spark, sf):
    """Pages packed as WARC records and read from them again."""
    found = warc.warc_pages(warc.unpacked_records(warc.packed_records(read(spark, sf, "pages"))))
    return found.select("url", F.octet_length("html").cast("long").alias("bytes"), F.md5(F.col("html").cast("binary")).alias("digest"))


@query()
def extracted_pages(spark, sf):
    pages = tables.extract_pages(read(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").alias("n_chars"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS white_words, CAST(len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)?')) AS BIGINT) AS letter_words, CAST(greatest(1, ceil(len(regexp_extract_all(text, '\\S+')) / 100.0)) AS BIGINT) AS units, sha256(substr(text, 1, 500)) AS prefix_sha256 FROM documents")
def word_counts(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", text.white_words(t).alias("white_words"), text.letter_words(t).alias("letter_words"), text.billable_units(t, 100).alias("units"), F.sha2(F.substring(t, 1, 500), 256).alias("prefix_sha256"))


PHRASES_SQL = text.PHRASE_PATTERN.replace("'", "''")


@query(f"SELECT conv_id, CAST(sum(len(regexp_extract_all(lower(text), '{PHRASES_SQL}'))) AS BIGINT) AS hits, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)?'))) AS BIGINT) AS words, round(1000.0 * sum(len(regexp_extract_all(lower(text), '{PHRASES_SQL}'))) / nullif(sum(len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)?'))), 0), 9) AS rate FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def phrase_rate(spark, sf):
    turns = read(spark, sf, "conversations").where("role = 'assistant'")
    sums = turns.groupBy("conv_id").agg(F.sum(text.phrase_hits(F.col("text"))).alias("hits"), F.sum(text.letter_words(F.col("text"))).alias("words"))
    return sums.withColumn("rate", F.round(F.try_divide(F.lit(1000.0) * F.col("hits"), F.col("words")), 9))


@query()
def cleaned_texts(spark, sf):
    """Label-model input of each turn: cleaned text and its evenly spaced windows of 16 words."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", text.cleaned_text(F.col("text")).alias("cleaned"))
    return turns.select("conv_id", "turn", "cleaned", F.transform(text.picked_windows(F.split("cleaned", " "), 16, 3), lambda w: F.array_join(w, " ")).alias("windows"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) >= 2 THEN (len(w) - 2) // 64 + 1 ELSE 0 END AS BIGINT) AS windows, CAST(CASE WHEN len(w) >= 2 THEN (len(w) - 2) // 64 * 64 ELSE NULL END AS BIGINT) AS last_start FROM t""")
def evaluation_windows(spark, sf):
    """Windows of 64 words; ``evaluation_windows_of_texts`` has those of 8."""
    found = read(spark, sf, "documents").select("doc_id", text.scored_windows(F.split("text", " "), 64).alias("x"))
    n = F.size("x").cast("long")
    return found.select("doc_id", n.alias("windows"), F.when(n > 0, (n - 1) * 64).alias("last_start"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) >= 2 THEN (len(w) - 2) // 8 + 1 ELSE 0 END AS BIGINT) AS windows, CAST(CASE WHEN len(w) >= 2 THEN (len(w) - 2) // 8 * 8 ELSE NULL END AS BIGINT) AS last_start FROM t""")
def evaluation_windows_of_texts(spark, sf):
    """As ``evaluation_windows``, of 8 words."""
    found = read(spark, sf, "documents").select("doc_id", text.scored_windows(F.split("text", " "), 8).alias("x"))
    n = F.size("x").cast("long")
    return found.select("doc_id", n.alias("windows"), F.when(n > 0, (n - 1) * 8).alias("last_start"))


@query(BASE + ", m AS (SELECT lang, label, CAST(sum(tokens) AS BIGINT) AS tokens FROM base WHERE label IS NOT NULL GROUP BY lang, label) SELECT lang, label, tokens, round(tokens / sum(tokens) OVER (PARTITION BY label), 9) AS share_of_label, round(tokens / sum(tokens) OVER (PARTITION BY lang), 9) AS share_within FROM m")
def rollup_shares(spark, sf):
    cells = measure.cube(base(spark, sf), ["lang", "label"])
    share = lambda by: F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(by)), 9)
    return cells.select("lang", "label", "tokens", share("label").alias("share_of_label"), share("lang").alias("share_within"))


@query(BASE + ", c AS (SELECT dump, lang, count(*) AS n, sum(CASE WHEN label = 'AI' THEN 1 ELSE 0 END) AS ai FROM base WHERE label IS NOT NULL GROUP BY dump, lang) SELECT dump, " + ", ".join(f"round(max(CASE WHEN lang = '{x}' AND n >= 3 THEN 100.0 * ai / n END), 9) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM c GROUP BY dump")
def share_heatmap(spark, sf):
    cells = base(spark, sf).where("label is not null").groupBy("dump", "lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == "AI", 1).otherwise(0)).alias("ai"))
    share = F.when(F.col("n") >= 3, F.lit(100.0) * F.col("ai") / F.col("n"))
    out = cells.withColumn("share", share).groupBy("dump").pivot("lang", ["de", "en", "es", "fr"]).agg(F.max("share"))
    return out.select("dump", *[F.round(x, 9).alias(x) for x in ("de", "en", "es", "fr")])


@query(BASE + ", t AS (SELECT lang, sum(CASE WHEN label = 'AI' THEN tokens ELSE 0 END) AS ai, sum(CASE WHEN label = 'Human' THEN tokens ELSE 0 END) AS human FROM base WHERE label IS NOT NULL GROUP BY lang) SELECT lang, round((ai / (SELECT sum(ai) FROM t)) / (human / (SELECT sum(human) FROM t)), 9) AS ratio FROM t")
def format_mismatch(spark, sf):
    t = base(spark, sf).where("label is not null").groupBy("lang").agg(*[F.sum(F.when(F.col("label") == x, F.col("tokens")).otherwise(0)).alias(x) for x in ("AI", "Human")])
    every = Window.partitionBy(F.lit(0))  # one row per language
    return t.select("lang", F.round(F.try_divide(F.col("AI") / F.sum("AI").over(every), F.col("Human") / F.sum("Human").over(every)), 9).alias("ratio"))


@query(BASE + ", s AS (SELECT dump, list_sort(list(tokens)) AS v FROM base GROUP BY dump) SELECT dump, v[len(v) // 2 + 1] AS middle, v[1] AS least, v[len(v)] AS most FROM s")
def budget_spread(spark, sf):
    found = measure.order_statistics(base(spark, sf), ["dump"], "tokens", {"middle": F.floor(F.col("rows") / 2), "least": F.lit(0), "most": F.col("rows") - 1})
    return found.select("dump", "middle", "least", "most")


@query(BASE + "SELECT lang, round(quantile_cont(tokens, 0.25), 6) AS q25, round(quantile_cont(tokens, 0.5), 6) AS q50, round(quantile_cont(tokens, 0.75), 6) AS q75 FROM base GROUP BY lang")
def quartile_band(spark, sf):
    q = measure.quantiles(base(spark, sf), ["lang"], "tokens", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.select("lang", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


@query()
def share_interval(spark, sf):
    """Bootstrap interval of the AI share of tokens per source."""
    return measure.poisson_interval(base(spark, sf), "dump", "id", seed=0, draws=500).withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query(f"SELECT doc_id AS id, sha256('{KEY}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents")
def rank_hashes(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), rank_hash(KEY, "doc_id").alias("h"))
