"""Queries over runs and evaluations: joins to controls, scaling laws, scores, mixtures and packing.

There are no run tables here; orders stand in for runs (customer: group), line items for losses and tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.functions import laws, solve
from webloom.functions.hashing import rank_hash
from webloom.operators import budget, measure, mixture, relational
from webloom.plans.base import BASE, KEY, base, query, read, read_in_order

RUNS_SQL = """WITH r AS (SELECT o_orderkey AS name, o_custkey AS grp, CAST(o_totalprice AS DOUBLE) AS amount, o_orderpriority AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
runs AS (SELECT name, grp, amount, size, CASE WHEN n = 1 THEN 'control' WHEN n % 2 = 0 THEN 'ai' ELSE 'human' END AS arm FROM r)
"""


def runs(spark, sf):
    """name, group, amount, size, arm: the first order of a customer is the control."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("grp"), F.col("o_totalprice").cast("double").alias("amount"), F.col("o_orderpriority").alias("size"))
    n = F.row_number().over(Window.partitionBy("grp").orderBy("name"))
    return o.withColumn("n", n).withColumn("arm", F.when(F.col("n") == 1, "control").when(F.col("n") % 2 == 0, "ai").otherwise("human")).drop("n")


@query(RUNS_SQL + "SELECT a.name, a.grp, a.arm, c.name AS control_name, round(100 * (a.amount / c.amount - 1), 6) AS change_pct FROM runs a JOIN runs c ON a.grp = c.grp AND c.arm = 'control'")
def change_from_control(spark, sf):
    joined = relational.with_control(runs(spark, sf), "grp")
    return joined.select("name", "grp", "arm", "control_name", F.round(100 * (F.col("amount") / F.col("control_amount") - 1), 6).alias("change_pct"))


@query(RUNS_SQL + ", c AS (SELECT * FROM runs WHERE amount > 300000) SELECT DISTINCT name, grp, arm FROM (SELECT * FROM c UNION ALL SELECT r.* FROM runs r WHERE arm = 'control' AND grp IN (SELECT grp FROM c))")
def chosen_with_controls(spark, sf):
    r = runs(spark, sf).select("name", "grp", "arm", "amount")
    return relational.control_closure(r, r.where("amount > 300000").select("name"), "name", "grp").select("name", "grp", "arm")


@query("""WITH a AS (SELECT o_orderkey AS name, o_orderpriority AS size, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT o_orderkey AS name, o_orderpriority AS size, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT a.name, b.name AS match_name, abs(ln(b.amount / a.amount)) AS distance FROM a JOIN b USING (size) WHERE abs(ln(b.amount / a.amount)) <= 0.15)
SELECT name, match_name, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, match_name) AS n FROM p) WHERE n = 1""")
def nearest_run(spark, sf):
    """Every run in progress (status P) and the finished one (F) of its size whose amount is nearest."""
    o = read(spark, sf, "orders")
    of = lambda status: o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("size"), F.col("o_totalprice").alias("amount"))
    found = relational.nearest(of("P"), of("F"), ["size"], "amount", "amount", 0.15, "name")
    return found.select("name", "match_name", F.round("distance", 9).alias("distance"))


@query(RUNS_SQL + """, p AS (SELECT a.name, b.name AS match_name, abs(ln(b.amount / a.amount)) AS distance FROM runs a JOIN runs b USING (size) WHERE a.arm = 'ai' AND b.arm = 'human' AND abs(ln(b.amount / a.amount)) <= 0.15)
SELECT name, match_name, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, match_name) AS n FROM p) WHERE n = 1""")
def nearest_human_run(spark, sf):
    """As ``nearest_run``, of every AI run among all human runs."""
    r = runs(spark, sf)
    arm = lambda x: r.where(F.col("arm") == x).select("name", "size", "amount")
    found = relational.nearest(arm("ai"), arm("human"), ["size"], "amount", "amount", 0.15, "name")
    return found.select("name", "match_name", F.round("distance", 9).alias("distance"))


@query(RUNS_SQL + "SELECT size, " + ", ".join(f"CAST(sum(CASE WHEN arm = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x}" for x in ("control", "ai", "human")) + ", count(*) AS runs, min(amount) AS least, max(amount) AS most FROM runs GROUP BY size UNION ALL SELECT 'all', " + ", ".join(f"CAST(sum(CASE WHEN arm = '{x}' THEN 1 ELSE 0 END) AS BIGINT)" for x in ("control", "ai", "human")) + ", count(*), min(amount), max(amount) FROM runs")
def run_inventory(spark, sf):
    arm = lambda x: F.sum(F.when(F.col("arm") == x, 1).otherwise(0)).cast("long").alias(x)
    out = runs(spark, sf).rollup("size").agg(arm("control"), arm("ai"), arm("human"), F.count("*").alias("runs"), F.min("amount").alias("least"), F.max("amount").alias("most"))
    return out.withColumn("size", F.coalesce("size", F.lit("all")))


@query(RUNS_SQL + ", k AS (SELECT grp, count(*) FILTER (WHERE arm = 'ai') AS n, min(name) AS first_name FROM runs GROUP BY grp) SELECT grp, n, first_name FROM k ORDER BY n DESC, first_name LIMIT 20")
def largest_groups(spark, sf):
    k = runs(spark, sf).groupBy("grp").agg(F.count(F.when(F.col("arm") == "ai", 1)).alias("n"), F.min("name").alias("first_name"))
    return k.orderBy(F.desc("n"), "first_name").limit(20)


@query(RUNS_SQL + "SELECT grp, list(name ORDER BY name) AS names FROM runs GROUP BY grp")
def group_members(spark, sf):
    return runs(spark, sf).groupBy("grp").agg(F.sort_array(F.collect_list("name")).alias("names"))


@query("SELECT o_orderkey AS name, CASE WHEN abs(o_totalprice / 50000 - 1) <= 0.1 THEN CAST(50000 AS DOUBLE) WHEN abs(o_totalprice / 100000 - 1) <= 0.1 THEN CAST(100000 AS DOUBLE) WHEN abs(o_totalprice / 200000 - 1) <= 0.1 THEN CAST(200000 AS DOUBLE) END AS budget FROM orders")
def snapped_budgets(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), relational.snap(F.col("o_totalprice"), (50_000, 100_000, 200_000), 0.1).alias("budget"))


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events) SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_line FROM e GROUP BY user_id""")
def latest_states(spark, sf):
    return relational.latest(read(spark, sf, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def candidates_in_and_not_in(spark, sf):
    items = read(spark, sf, "lineitem")
    wanted = read(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    inside = items.join(wanted, "l_partkey", "left_semi").select("l_partkey").distinct()
    return inside.join(items.where("l_quantity > 49").select("l_partkey"), "l_partkey", "left_anti").select(F.col("l_partkey").alias("id"))


@query("""WITH c AS (SELECT l_partkey AS id, l_suppkey AS digest, l_returnflag AS model, min(l_orderkey) AS result FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2, 3), q AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS digest, l_returnflag AS model FROM lineitem WHERE l_linenumber = 2)
SELECT q.id, q.digest, q.model, c.result FROM q LEFT JOIN c ON q.id = c.id AND q.digest = c.digest AND q.model = c.model""")
def cached_results(spark, sf):
    items = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("digest"), F.col("l_returnflag").alias("model"), "l_orderkey", "l_linenumber")
    key = ["id", "digest", "model"]
    cached = items.where("l_linenumber = 1").groupBy(*key).agg(F.min("l_orderkey").alias("result"))
    return items.where("l_linenumber = 2").select(*key).distinct().join(cached, key, "left")


# Rounded published coefficients of the effective-data law on the C4 target.
C4 = {"logE": math.log(0.556), "logA": math.log(0.205), "alpha": 0.36, "logB": math.log(0.418), "beta": 0.23, "logeta": math.log(0.6), "logK": math.log(0.31), "rho": -0.9, "gamma": 0.06, "u": -0.3, "v": -0.1}
OTHER = C4 | {
    "log_rn_star": 1.0, "sigma": 0.1, "power": 0.8, "log_transfer": -0.5, "family_power": 0.03, "domain_h_rate": 0.01, "domain_ai_rate": -0.01, "log_mix_h": 3.0, "log_mix_ai": 3.2, "mix_h_power": 0.9, "mix_ai_power": 1.1,
    "log_model_h": -1.5, "log_model_ai": -1.4, "model_mix_power": 1.0, "log_data_h": -0.9, "log_data_ai": -0.7, "data_mix_power": 0.9, "share_tax": 0.03, "size_coupling": 0.1, "log_surrogate_noise": 0.5, "mismatch": 0.03,
}
#: Suppliers as models: the balance sets the size, the nation the budget; each with nine ratios of added tokens.
GRID_SQL = "WITH g AS (SELECT s_suppkey, params, params * 20 * (s_nationkey % 6 + 1) AS human, CAST(a AS DOUBLE) / 4 AS ratio FROM (SELECT s_suppkey, s_nationkey, 1e8 + (CAST(s_acctbal AS DOUBLE) + 1000) * 1e5 AS params FROM supplier), range(9) v(a)), x AS (SELECT params, human, ratio, params / 1e8 AS n, human / 1e9 AS d, ratio AS r, human / (20 * params) AS t FROM g)\n"


def grid(spark, sf):
    """Sizes and budgets by added ratios."""
    models = read(spark, sf, "supplier").select("s_nationkey", (F.lit(1e8) + (F.col("s_acctbal").cast("double") + 1_000) * F.lit(1e5)).alias("params"))
    g = models.select("params", (F.col("params") * 20 * (F.col("s_nationkey") % 6 + 1)).alias("human"), F.explode(F.array(*[F.lit(a / 4) for a in range(9)])).alias("ratio"))
    return laws.with_coordinates(g.withColumn("added", F.col("human") * F.col("ratio")), "params", "human", "added")


def coordinates():
    return laws.Coordinates(*[F.col(c) for c in ("n", "d", "r", "t")])


@query(GRID_SQL + "SELECT params, human, ratio, round(0.556 + 0.205 * pow(n, -0.36) + 0.418 * pow(d * (1 + 0.6 * w * (1 - exp(-r / w))), -0.23) * (1 + 0.06 * pow(t, -0.3) * pow(n, -0.1) * (ln(1 + r) - r / (1 + r))), 8) AS loss FROM (SELECT *, 0.31 * pow(t, -0.9) AS w FROM x)")
def effective_data_law(spark, sf):
    return grid(spark, sf).select("params", "human", "ratio", F.round(laws.effective_data_law(C4, coordinates()), 8).alias("loss"))


@query(GRID_SQL + """, y AS (SELECT *, d * (1 + r) AS tot, r / (1 + r) AS f, 1 / (1 + r) AS h, 0.556 + 0.205 * pow(n, -0.36) AS m, 1 / (exp(3.0) * pow(1 / (1 + r), 0.9) + exp(3.2) * CASE WHEN r > 0 THEN pow(r / (1 + r), 1.1) ELSE 0 END) AS fl, 0.31 * pow(t, -0.9) * pow(n, 0.1) AS w, least(pow(0.36 * 0.205 / (0.23 * 0.418), 1 / 0.36) * pow(d, 0.23 / 0.36), n) AS un FROM x)
SELECT params, human, ratio, round(m + 0.418 * pow(tot, -0.23), 8) AS chinchilla, round(0.556 + 0.205 * pow(un * (1 + exp(1.0) * (1 - exp(-(n / un - 1) / exp(1.0)))), -0.36) + 0.418 * pow(d * (1 + 0.31 * (1 - exp(-r / 0.31))), -0.23), 8) AS muennighoff,
round(m + 0.418 * pow(d * (1 + w * (1 - exp(-r / w))), -0.23), 8) AS windowed, round(m + 0.418 * pow(tot, -0.23) + 0.06 * CASE WHEN r > 0 THEN pow(r, 0.8) ELSE 0 END * pow(t, -0.3) * pow(n, -0.1), 8) AS lovelace, round(m + 0.418 * pow(d * (1 + exp(-0.5) * r), -0.23), 8) AS atlas,
round((m + 0.418 * pow(tot, -0.23)) * exp(-0.03 * ln(h)), 8) AS he, round(m + 0.418 * exp(-0.23 * ln(tot) - 0.01 * h * ln(d * 1e9) + 0.01 * f * (ln(d * 1e9) + CASE WHEN r > 0 THEN ln(r) ELSE 0 END)), 8) AS hamidieh, round(m + 0.418 * pow(tot, -0.23) + fl, 8) AS shukor_additive,
round(0.556 + (exp(-1.5) * h + exp(-1.4) * f) * pow(n, -0.36) + pow(exp(-0.9) * h + exp(-0.7) * f, 0.9) * pow(tot, -0.23) + fl, 8) AS shukor_joint, round(m + pow(n, 0.1) * 0.418 * pow(d * (1 + exp(-0.5) * r), -0.23) + 0.03 * f, 8) AS sedova, round(m + 0.418 * pow((1 + exp(0.5) * r) / pow(1 + r, 2) / d, 0.23) + 0.03 * f * f, 8) AS jain FROM y""")
def rival_laws(spark, sf):
    x = coordinates()
    return grid(spark, sf).select("params", "human", "ratio", *[F.round(law(OTHER, x), 8).alias(name) for name, law in laws.LAWS.items() if name != "effective_data"])


# Credits and harms of the effective-data law in SQL, over n, d, r, t and the window w.
CREDITS = {"none": "0", "linear": "0.6 * r", "exp": "0.6 * w * (1 - exp(-r / w))", "rational": "0.6 * r / (1 + r / w)", "tanh": "0.6 * w * ((1 - exp(-2 * r / w)) / (1 + exp(-2 * r / w)))"}
HARMS = {"none": "0", "logshare": "(ln(1 + r) - r / (1 + r))", "log": "ln(1 + r)", "boxcox": "(exp(-0.4 * ln(1 + r)) - 1) / -0.4", "power": "CASE WHEN r > 0 THEN pow(r, 0.8) ELSE 0 END"}


@query(GRID_SQL + "SELECT params, human, ratio, " + ", ".join(f"round(0.556 + 0.205 * pow(n, -0.36) + {data}, 8) AS {c}_{h}_{on}" for c, credit in CREDITS.items() for h, harm in HARMS.items() for on, data in (("data", f"0.418 * pow(d * (1 + {credit}), -0.23) * (1 + 0.06 * pow(t, -0.3) * pow(n, -0.1) * {harm})"), ("loss", f"0.418 * pow(d * (1 + {credit}), -0.23) + 0.06 * pow(t, -0.3) * pow(n, -0.1) * {harm}"))) + " FROM (SELECT *, 0.31 * pow(t, -0.9) * pow(n, 0.1) AS w FROM x)")
def law_ablations(spark, sf):
    """Every credit and harm of the effective-data law over the grid."""
    x, p = coordinates(), OTHER | {"lam": -0.4}
    forms = [F.round(laws.effective_data_law(p, x, credit=c, harm=h, on_data=on), 8).alias(f"{c}_{h}_{'data' if on else 'loss'}") for c in ("none", "linear", "exp", "rational", "tanh") for h in ("none", "logshare", "log", "boxcox", "power") for on in (True, False)]
    return grid(spark, sf).select("params", "human", "ratio", *forms)


@query(GRID_SQL + ", l AS (SELECT *, 0.556 + 0.205 * pow(n, -0.36) + 0.418 * pow(d * (1 + 0.6 * w * (1 - exp(-r / w))), -0.23) * (1 + 0.06 * pow(t, -0.3) * pow(n, -0.1) * (ln(1 + r) - r / (1 + r))) AS loss FROM (SELECT *, 0.31 * pow(t, -0.9) AS w FROM x)), b AS (SELECT params, human, max(CASE WHEN ratio = 0 THEN loss END) AS control, min(loss) AS best, arg_min(ratio, loss) AS ratio FROM l GROUP BY params, human) SELECT params, human, ratio AS best_ratio, round(greatest(0, 1 - best / control), 8) AS reduction, round(ratio / (1 + ratio), 9) AS best_share FROM b")
def optimal_ratio(spark, sf):
    l = grid(spark, sf).withColumn("loss", laws.effective_data_law(C4, coordinates()))  # noqa: E741
    b = l.groupBy("params", "human").agg(F.max(F.when(F.col("ratio") == 0, F.col("loss"))).alias("control"), F.min("loss").alias("best"), F.min_by("ratio", "loss").alias("ratio"))
    return b.select("params", "human", F.col("ratio").alias("best_ratio"), F.round(F.greatest(F.lit(0.0), 1 - F.col("best") / F.col("control")), 8).alias("reduction"), F.round(F.col("ratio") / (1 + F.col("ratio")), 9).alias("best_share"))


ERRORS_SQL = "WITH e AS (SELECT l_returnflag AS target, l_suppkey AS grp, l_discount - 0.05 AS ours, l_tax - 0.04 AS theirs, l_linenumber AS depth FROM lineitem)\n"


def errors(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_suppkey").alias("grp"), (F.col("l_discount") - 0.05).alias("ours"), (F.col("l_tax") - 0.04).alias("theirs"), F.col("l_linenumber").alias("depth"))


@query(ERRORS_SQL + ", s(slice, cut) AS (VALUES ('all', 99), ('small', 3), ('one', 1)) SELECT target, slice, count(*) AS runs, round(sqrt(avg(ours * ours)), 9) AS ours, round(sqrt(avg(theirs * theirs)), 9) AS theirs FROM e JOIN s ON depth <= cut GROUP BY target, slice")
def sliced_scores(spark, sf):
    slices = F.array(*[F.struct(F.lit(n).alias("slice"), F.lit(c).alias("cut")) for n, c in (("all", 99), ("small", 3), ("one", 1))])
    rows = errors(spark, sf).withColumn("s", F.explode(slices)).where("depth <= s.cut")
    return rows.groupBy("target", F.col("s.slice").alias("slice")).agg(F.count("*").alias("runs"), F.round(measure.rmse(F.col("ours")), 9).alias("ours"), F.round(measure.rmse(F.col("theirs")), 9).alias("theirs"))


@query(ERRORS_SQL + ", g AS (SELECT target, grp, sum(ours * ours) AS a, sum(theirs * theirs) AS b, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT target, sum(a) AS a, sum(b) AS b, sum(n) AS n FROM g GROUP BY 1), d AS (SELECT g.target, sqrt((t.a - g.a) / (t.n - g.n)) - sqrt((t.b - g.b) / (t.n - g.n)) AS gap FROM g JOIN t USING (target)) SELECT target, round(min(gap), 8) AS least, round(max(gap), 8) AS most FROM d GROUP BY target")
def leave_one_group_out(spark, sf):
    gaps = measure.leave_one_out_gap(errors(spark, sf), "target", "grp", "ours", "theirs")
    return gaps.groupBy("target").agg(F.round(F.min("gap"), 8).alias("least"), F.round(F.max("gap"), 8).alias("most"))


@query(ERRORS_SQL + "SELECT target, count(*) AS pairs, round(sqrt(avg((ours - theirs) * (ours - theirs))), 9) AS rmse, CAST(sum(CASE WHEN sign(ours) = sign(theirs) THEN 1 ELSE 0 END) AS BIGINT) AS direction_right, CAST(sum(CASE WHEN ours > 0 THEN 1 ELSE 0 END) AS BIGINT) AS helps FROM e GROUP BY target")
def direction_summary(spark, sf):
    return errors(spark, sf).groupBy("target").agg(F.count("*").alias("pairs"), F.round(measure.rmse(F.col("ours") - F.col("theirs")), 9).alias("rmse"), F.sum((F.signum("ours") == F.signum("theirs")).cast("long")).alias("direction_right"), F.sum((F.col("ours") > 0).cast("long")).alias("helps"))


@query("WITH d AS (SELECT o_orderpriority AS source, o_orderstatus AS domain, sum(l_extendedprice) / (ln(2) * sum(CASE WHEN l_quantity > 5 THEN l_quantity END)) AS bpb FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), s AS (SELECT source, avg(bpb) AS bpb FROM d GROUP BY 1) SELECT 'macro' AS level, round(avg(bpb), 6) AS bpb, count(*) AS sources FROM s")
def macro_average(spark, sf):
    items = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    bpb = F.sum("l_extendedprice") / (math.log(2) * F.sum(F.when(F.col("l_quantity") > 5, F.col("l_quantity"))))
    domains = items.groupBy("o_orderpriority", "o_orderstatus").agg(bpb.alias("bpb"))
    return domains.groupBy("o_orderpriority").agg(F.avg("bpb").alias("bpb")).agg(F.lit("macro").alias("level"), F.round(F.avg("bpb"), 6).alias("bpb"), F.count("*").alias("sources")).select("level", "bpb", "sources")


@query("WITH t AS (SELECT o_orderpriority AS task, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS acc FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT round(avg((acc - 0.25) / 0.75), 9) AS core, round(avg(acc), 9) AS accuracy, count(*) AS tasks FROM t")
def centred_accuracy(spark, sf):
    items = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    tasks = items.groupBy("o_orderpriority").agg(F.avg((F.col("l_returnflag") == "N").cast("double")).alias("acc"))
    return tasks.agg(F.round(F.avg((F.col("acc") - 0.25) / 0.75), 9).alias("core"), F.round(F.avg("acc"), 9).alias("accuracy"), F.count("*").alias("tasks"))


@query("WITH w AS (SELECT l_orderkey AS id, avg(l_discount) AS p0, avg(l_tax) AS p1, avg(l_quantity / 500) AS p2 FROM lineitem GROUP BY 1) SELECT id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS bucket, round((p1 + 2 * p2) / 2, 9) AS score FROM w")
def window_probabilities(spark, sf):
    """Means of an id's windows, summed in the order of the table: which of two equal means is larger depends on the order."""
    probs = {"p0": F.col("l_discount"), "p1": F.col("l_tax"), "p2": F.col("l_quantity") / 500}
    items = read_in_order(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "__file", "__row", *[p.alias(c) for c, p in probs.items()])
    ordered = Window.partitionBy("id").orderBy("__file", "__row")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = items.select("id", F.lead("__row").over(ordered).isNull().alias("last"), *[(F.sum(c).over(so_far) / F.count(c).over(so_far)).alias(c) for c in probs])
    p0, p1, p2 = map(F.col, probs)
    bucket = F.when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)
    return running.where("last").select("id", bucket.alias("bucket"), F.round((p1 + 2 * p2) / 2, 9).alias("score"))


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) / 400000 AS share FROM orders GROUP BY 1) SELECT month, 'observed' AS kind, round(share, 9) AS share FROM m WHERE month >= '1996-01'")
def observed_shares(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.avg("o_totalprice") / 400_000).alias("share"))
    table = measure.forecast_table(m, "1996-01", "2003-12")
    return table.where("kind = 'observed'").select("month", "kind", F.round("share", 9).alias("share"))


# Student's quantiles by bisection, the density summed by Simpson's rule.
FORECAST_SQL = """WITH RECURSIVE m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) / 400000 AS share FROM orders GROUP BY 1),
o AS MATERIALIZED (SELECT month, share, CAST(substr(month, 1, 4) AS BIGINT) * 12 + CAST(substr(month, 6, 2) AS BIGINT) - 1 AS place FROM m WHERE month >= '1996-01'),
e AS MATERIALIZED (SELECT min(place) AS t0, max(place) AS t1, arg_min(share, place) AS s0, arg_max(share, place) AS s1, count(*) AS n, CAST(count(*) - 2 AS DOUBLE) AS v FROM o),
s AS (SELECT place - lag(place) OVER (ORDER BY place) AS gap, share - lag(share) OVER (ORDER BY place) AS rise FROM o),
f AS MATERIALIZED (SELECT e.*, (s1 - s0) / (t1 - t0) AS drift, (SELECT sum(pow((rise - (s1 - s0) / (t1 - t0) * gap) / sqrt(gap), 2)) FROM s WHERE gap IS NOT NULL) / (n - 2) AS variance FROM e),
b AS (SELECT p, CAST(0 AS DOUBLE) AS low, CAST(50 AS DOUBLE) AS high, 0 AS step FROM (VALUES (0.9), (0.975)) x(p)
  UNION ALL SELECT p, CASE WHEN below < p THEN middle ELSE low END, CASE WHEN below < p THEN high ELSE middle END, step + 1
  FROM (SELECT b.*, (low + high) / 2 AS middle, 0.5 + (low + high) / 2 / 12000 * list_sum(list_transform(range(4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow((low + high) / 2 * i / 4000, 2) / v, -(v + 1) / 2))) AS below FROM b, e WHERE step < 60)),
q AS (SELECT max(CASE WHEN p = 0.9 THEN (low + high) / 2 END) AS q80, max(CASE WHEN p = 0.975 THEN (low + high) / 2 END) AS q95 FROM b WHERE step = 60),
a AS (SELECT t1 + h AS place, s1 + drift * h AS mean, sqrt(variance * (h + h * h / (t1 - t0))) AS sd, q80, q95 FROM f, q, range(1, 2003 * 12 + 12 - CAST((SELECT t1 FROM e) AS BIGINT)) r(h))
SELECT month, 'observed' AS kind, round(share, 9) AS share, CAST(NULL AS DOUBLE) AS lo80, CAST(NULL AS DOUBLE) AS hi80, CAST(NULL AS DOUBLE) AS lo95, CAST(NULL AS DOUBLE) AS hi95 FROM o
UNION ALL SELECT lpad(CAST(place // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(place % 12 + 1 AS VARCHAR), 2, '0'), 'forecast', """ + ", ".join(f"round(greatest(0.0, least(1.0, {x})), 9)" for x in ("mean", "mean - q80 * sd", "mean + q80 * sd", "mean - q95 * sd", "mean + q95 * sd")) + " FROM a"


@query(FORECAST_SQL)
def share_forecast(spark, sf):
    """Drift forecast of a monthly share with 80 and 95 % intervals."""
    m = read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.avg("o_totalprice") / 400_000).alias("share"))
    table = measure.forecast_table(m, "1996-01", "2003-12")
    return table.select("month", "kind", *[F.round(c, 9).alias(c) for c in ("share", "lo80", "hi80", "lo95", "hi95")])


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, min(o_custkey) AS v FROM orders GROUP BY 1) SELECT month, v - lag(v) OVER (ORDER BY month) AS rise FROM m")
def lagged_difference(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.min("o_custkey").alias("v"))
    return m.select("month", (F.col("v") - F.lag("v").over(Window.partitionBy(F.lit(0)).orderBy("month"))).alias("rise"))  # one row per month


PLAN_SQL = BASE + ", p AS (SELECT id, h, least(tokens, 513) AS tokens, coalesce(label, 'Human') <> 'AI' AS human FROM base), c AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY human ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM p)\n"


def _pools(spark, sf):
    docs = base(spark, sf).select("id", F.substring("h", 1, 16).alias("h"), "tokens", (F.coalesce("label", F.lit("Human")) == "AI").alias("ai"))
    return docs.where("not ai").drop("ai"), docs.where("ai").drop("ai")


@query(PLAN_SQL + "SELECT 'human' AS pool, id, least(tokens, 20520 - prior) AS tokens FROM c WHERE human AND prior < 20520 UNION ALL SELECT 'ai', id, least(tokens, 4104 - prior) FROM c WHERE NOT human AND prior < 4104")
def mixture_plan(spark, sf):
    human, ai = _pools(spark, sf)
    return mixture.plan(mixture.Run("ai", 5, 6), human, ai, 4_104, 513).select("pool", "id", "tokens")


#: The other arms: human text of its own added, the web's mix, the same without what was added, and human text alone.
ARM_SQL = ", first AS (SELECT pool, id, least(tokens, {human} - prior) AS tokens FROM (SELECT *, CASE WHEN human THEN 'human' ELSE 'ai' END AS pool FROM c) WHERE human AND prior < {human})"


@query(PLAN_SQL + ARM_SQL.format(human=10_260) + """, rest AS (SELECT id, tokens, CAST(coalesce(sum(tokens) OVER (ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM c WHERE human AND prior >= 10260)
SELECT * FROM first UNION ALL SELECT 'human', id, least(tokens, 5130 - prior) FROM rest WHERE prior < 5130""")
def human_plan(spark, sf):
    """As ``mixture_plan``, with the human documents that follow in place of AI ones."""
    human, _ = _pools(spark, sf)
    return mixture.plan(mixture.Run("human", 4, 6), human, None, 2_565, 513).select("pool", "id", "tokens")


def _web_mix(arm):
    """A run of 9 steps' tokens of the web's mix: 7 human and 2 AI steps."""
    return mixture.Run.planned(arm, 9 * 2_565, 1, 2_565)


@query(PLAN_SQL + ARM_SQL.format(human=17_955) + " SELECT * FROM first UNION ALL SELECT 'ai', id, least(tokens, 5130 - prior) FROM c WHERE NOT human AND prior < 5130")
def natural_plan(spark, sf):
    return mixture.plan(_web_mix("natural"), *_pools(spark, sf), 2_565, 513).select("pool", "id", "tokens")


@query(PLAN_SQL + ARM_SQL.format(human=17_955) + " SELECT * FROM first")
def filtered_plan(spark, sf):
    """The natural run's human documents alone."""
    human, _ = _pools(spark, sf)
    return mixture.plan(_web_mix("filtered"), human, None, 2_565, 513).select("pool", "id", "tokens")


@query(PLAN_SQL + ARM_SQL.format(human=10_260) + " SELECT * FROM first")
def control_plan(spark, sf):
    human, _ = _pools(spark, sf)
    return mixture.plan(mixture.Run("control", 4, 4), human, None, 2_565, 513).select("pool", "id", "tokens")


@query(PLAN_SQL + "SELECT 'human' AS pool, count(*) AS documents, CAST(25650 AS BIGINT) AS tokens FROM c WHERE human AND prior < 10260")
def repeated_plan(spark, sf):
    human, _ = _pools(spark, sf)
    planned = mixture.plan(mixture.Run("repeat", 4, 10), human, None, 2_565, 513)
    return mixture.plan_summary(planned)


@query("WITH r AS (SELECT o_orderkey AS name, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders) SELECT name, row // 64 AS step, row % 64 // 16 AS rank, row % 16 AS place FROM r")
def rank_slices(spark, sf):
    keyed = read(spark, sf, "orders").select(F.col("o_orderkey").alias("name"))
    return mixture.rank_rows(budget.running_total(keyed, "name", F.lit(1), ties=(), name="row"), 64, 4).select("name", "step", "rank", "place")


@query("""WITH RECURSIVE d AS (SELECT doc_id // 100 AS shard, doc_id, CAST(least(1000, greatest(1, ceil(n_chars / 100))) AS BIGINT) AS units, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS n FROM documents),
p AS (SELECT shard, doc_id, units, n, CAST(0 AS BIGINT) AS job, units AS total, 1 AS items FROM d WHERE n = 1
  UNION ALL SELECT d.shard, d.doc_id, d.units, d.n, p.job + CASE WHEN p.total + d.units > 1000 OR p.items = 20 THEN 1 ELSE 0 END, CASE WHEN p.total + d.units > 1000 OR p.items = 20 THEN d.units ELSE p.total + d.units END, CASE WHEN p.total + d.units > 1000 OR p.items = 20 THEN 1 ELSE p.items + 1 END FROM p JOIN d ON d.shard = p.shard AND d.n = p.n + 1)
SELECT shard, doc_id, units, job FROM p""")
def packed_jobs(spark, sf):
    """Billable jobs of consecutive documents of each file, here of 100 ids."""
    docs = read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).cast("long").alias("shard"), "doc_id", F.least(F.lit(1000), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 100))).cast("long").alias("units"))
    return mixture.jobs_by_shard(docs, "shard", "doc_id", "units", 1_000, 20)


@query()
def packed_rows(spark, sf):
    """The documents of each of 16 readers packed into rows of 2,048 characters."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), rank_hash(KEY, "doc_id").alias("h"), F.col("n_chars").cast("long").alias("length"))
    return mixture.pack_rows(docs.where("length > 0").withColumn("reader", mixture.reader_of("h", 16)), "reader", "h", "length", 2_048, keep_rest=True)


@query()
def law_equations(spark, sf):
    """Cost of not filtering, value of added tokens, optimal ratio and equivalent tokens over sizes and budgets."""
    law, n, h = laws.effective_data_law, F.col("params"), F.col("human")
    # Solving takes long for a row, so few rows are dealt over all cores.
    rows = grid(spark, sf).where("ratio = 0.5").select("params", "human").repartition(spark.sparkContext.defaultParallelism)
    found = rows.select("params", "human", solve.cost_of_not_filtering(law, C4, n, h, F.lit(mixture.WEB_AI_SHARE)).alias("cost"), solve.token_value(law, C4, n, h, 0.5 * h).alias("value"), solve.optimal_ratio(law, C4, n, h).alias("ratio"), solve.equivalent_tokens(law, C4, n, solve.loss(law, C4, n, h, F.lit(0.0)), 0.2, 5.0, 400.0).alias("same"))
    return found.select("params", "human", *[F.round(c, 6).alias(c) for c in ("cost", "value", "ratio")], F.round("same.tokens", -3).alias("tokens"), F.col("same.status").alias("status"))
