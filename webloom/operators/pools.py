"""Label-driven preselection and pools in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators import budget
from webloom.operators.relational import first_occurrence


def preselect(df: DataFrame, human_budget: int, *, dump: str = "dump", bucket: str = "bucket", hash_col: str = "h", tokens: str = "tokens") -> DataFrame:
    """All documents of bucket 2 and up; none of bucket 1; of bucket 0 each dump's quota in proportion to its tokens of the first kind. ``selection`` names the reason."""
    ai = F.col(bucket) >= 2
    totals = df.groupBy(dump).agg(F.sum(F.when(ai, F.col(tokens)).otherwise(0)).cast("long").alias("ai_tokens"), F.sum(F.when(F.col(bucket) == 0, F.col(tokens)).otherwise(0)).cast("long").alias("available"))
    wanted = budget.quotas(totals, human_budget, by=[dump])
    human = df.where(F.col(bucket) == 0).join(wanted, dump)
    chosen = budget.fill_budget(human, hash_col, tokens, F.col("quota"), by=[dump], with_ties=True).drop("quota")
    return df.where(ai).withColumn("selection", F.lit("editlens_ai")).unionByName(chosen.withColumn("selection", F.lit("editlens_human")))


def natural_draw(df: DataFrame, k: int, *, hash_col: str = "h", id_col: str = "id") -> DataFrame:
    """k documents whatever their label, ties of the last hash included."""
    chosen = budget.fill_budget(df.withColumn("__one", F.lit(1)), hash_col, "__one", k, ties=(id_col,), with_ties=True)
    return chosen.drop("__one").withColumn("selection", F.lit("natural"))


def pool_of(label: Column, selection: Column) -> Column:
    """The pool of a candidate, null if it is left out."""
    natural = selection == "natural"
    return F.when(label.isNull(), F.when(natural, F.lit("_unlabeled_natural")).otherwise(F.lit("_unlabeled"))).when(natural, F.when(label.isin("Human", "AI"), F.lit("natural"))).otherwise(F.lower(label))


def build_pools(df: DataFrame, *, id_col: str = "id", order: str = "ordinal") -> DataFrame:
    """The first occurrence of every id and its pool; what belongs to none goes."""
    return first_occurrence(df, [id_col], [order]).withColumn("pool", pool_of(F.col("label"), F.col("selection"))).where("pool is not null")


def pool_stats(pools: DataFrame, tokens: str = "tokens") -> DataFrame:
    return pools.groupBy("pool").agg(F.count("*").alias("documents"), F.sum(tokens).cast("long").alias("tokens"))


def sorted_pools(pools: DataFrame, hash_col: str = "h", id_col: str = "id") -> DataFrame:
    """In hash order across files and within them, without a single-task sort."""
    return pools.repartitionByRange(hash_col, id_col).sortWithinPartitions(hash_col, id_col)


def held_out_tail(natural: DataFrame, pools: DataFrame, target: int, *, hash_col: str = "h", id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """From the largest hash down the documents that are in no pool, until ``target`` tokens."""
    free = natural.join(pools.select(id_col), id_col, "left_anti")
    return budget.fill_budget(free, hash_col, tokens, target, ties=(id_col,), descending=True)


def pool_stats_of(candidates: DataFrame, *, tokens: str = "tokens", id_col: str = "id", order: str = "ordinal") -> DataFrame:
    """``pool_stats`` of the pools that ``build_pools`` makes of the candidates, with rows for what is in none: _duplicates (rows beyond the first of an id) and _left_out (first rows of no pool). The candidates are read once."""
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(order)) == 1
    placed = candidates.select(tokens, first.alias("__first"), pool_of(F.col("label"), F.col("selection")).alias("__pool"))
    pool = F.when(~F.col("__first"), F.lit("_duplicates")).otherwise(F.coalesce("__pool", F.lit("_left_out")))
    counts = placed.groupBy(pool.alias("pool")).agg(F.count("*").alias("documents"), F.sum(tokens).cast("long").alias("tokens"))
    outside = ("_duplicates", "_left_out")
    both = counts.unionByName(candidates.sparkSession.createDataFrame([(p, 0, 0) for p in outside], "pool string, documents long, tokens long"))
    return both.groupBy("pool").agg(F.sum("documents").alias("documents"), F.sum(F.when(~F.col("pool").isin(*outside), F.col("tokens"))).alias("tokens"))


def shaped_candidates(df: DataFrame, selection: str, label_columns: dict[str, str]) -> DataFrame:
    """``df`` with its selection, and nulls for the label columns (name: type) it hasn't."""
    missing = {c: F.lit(None).cast(t) for c, t in label_columns.items() if c not in df.columns}
    return df.withColumns({"selection": F.lit(selection)} | missing)


def by_label(df: DataFrame, label: str = "label", labels: tuple[str, ...] = ("Human", "AI")) -> dict[str, DataFrame]:
    """The set as a whole (``all``) and the part of each label."""
    return {"all": df} | {x.lower(): df.where(F.col(label) == x) for x in labels}


def manifest(df: DataFrame, by: list[str], *, text_col: str = "text", tokens: str = "tokens") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(F.char_length(text_col)).cast("long").alias("characters"), F.sum(tokens).cast("long").alias("tokens"))
