"""Queries over a study: runs joined with losses, pairs, folds, predictions, scores, contrasts and fits.

Suppliers stand in for groups of runs: the key sets a group's size and budget, the balance moves the budget. Each group has a
control, runs with AI tokens and runs with fresh human tokens added. A run's loss is a law's value, moved by up to half
a percent by a hash of its name; on the target "ai" added AI tokens help.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from webloom.functions import laws
from webloom.operators import fits, runs
from webloom.plans.base import query, read
from webloom.plans.studies import C4, CREDITS, ERRORS_SQL, HARMS, OTHER, errors

SIZES, BUDGETS, ADDED = 5, 4, 7
#: A group's human tokens, in runs without more of them.
FIRST = "CAST((s + 1) * 1e8 * 20 * (b + 1) AS DOUBLE) * (1 + abs(balance) / 20000)"
CASES = {("effective_data", "human", "all"): C4, ("chinchilla", "human", "all"): OTHER}

LOSS = "0.556 + 0.205 * pow(n, -0.36) + 0.418 * pow(d * (1 + 0.6 * w * (1 - exp(-r / w))), -0.23) * (1 + 0.06 * pow(t, -0.3) * pow(n, -0.1) * (ln(1 + r) - r / (1 + r)))"
STUDY = f"""WITH g AS (SELECT CAST(k AS VARCHAR) || '-' || CAST(b AS VARCHAR) || '-' || CAST(a AS VARCHAR) AS name, CAST(k AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS grp, CAST(k AS VARCHAR) || '-' || CAST(b AS VARCHAR) || '-0' AS control, 6 + 4 * CAST(s AS INT) AS size,
  CASE WHEN a = 0 THEN 'control' WHEN a <= 4 THEN 'ai' ELSE 'human' END AS arm, (s + 1) * 1e8 AS parameters, {FIRST} * CASE WHEN a > 4 THEN 1 + CAST(a - 4 AS DOUBLE) / 2 ELSE 1 END AS human, CASE WHEN a <= 4 THEN {FIRST} * a / 2 ELSE 0 END AS added FROM (SELECT s_suppkey AS k, s_suppkey % {SIZES} AS s, s_suppkey % {BUDGETS} AS b, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier), range({ADDED}) z(a)),
x AS (SELECT *, parameters / 1e8 AS n, human / 1e9 AS d, added / human AS r, human / (20 * parameters) AS t FROM g),
l AS (SELECT *, ({LOSS}) * (1 + (CAST('0x' || substr(sha256(name), 1, 4) AS BIGINT) / 65535.0 - 0.5) / 100) AS loss FROM (SELECT *, 0.31 * pow(t, -0.9) AS w FROM x))
"""


def study(spark, sf):
    """name, grp, control, size, arm, parameters, human, added."""
    g = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % SIZES).alias("s"), (F.col("s_suppkey") % BUDGETS).alias("b"), F.col("s_acctbal").cast("double").alias("balance"))
    g = g.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ADDED - 1).cast("long"))))
    grp = F.concat_ws("-", F.col("k").cast("string"), F.col("b").cast("string"))
    named = lambda a: F.concat_ws("-", grp, a)
    first = (F.col("s") + 1) * F.lit(1e8) * 20 * (F.col("b") + 1) * (1 + F.abs("balance") / 20_000)
    arm = F.when(F.col("a") == 0, "control").when(F.col("a") <= 4, "ai").otherwise("human")
    return g.select(
        named(F.col("a").cast("string")).alias("name"), grp.alias("grp"), named(F.lit("0")).alias("control"), (6 + 4 * F.col("s")).cast("int").alias("size"), arm.alias("arm"), ((F.col("s") + 1) * F.lit(1e8)).alias("parameters"),
        (first * F.when(F.col("a") > 4, 1 + (F.col("a") - 4) / 2).otherwise(1.0)).alias("human"), F.when(F.col("a") <= 4, first * F.col("a") / 2).otherwise(0.0).alias("added"),
    )


def losses(spark, sf):
    """name, target, loss."""
    rows = study(spark, sf)
    x = laws.Coordinates.of(F.col("parameters"), F.col("human"), F.col("added"))
    noise = 1 + (F.conv(F.substring(F.sha2("name", 256), 1, 4), 16, 10).cast("double") / 65535.0 - 0.5) / 100
    human = rows.select("name", F.lit("human").alias("target"), (laws.effective_data_law(C4, x) * noise).alias("loss"))
    ai = rows.select("name", F.lit("ai").alias("target"), (F.lit(0.9) - 0.1 * x.r / (1 + x.r)).alias("loss"))
    return human.unionByName(ai)


def _with_losses(spark, sf, targets=("human",)):
    return runs.with_losses(study(spark, sf), losses(spark, sf), targets)


@query(STUDY + "SELECT name, 'human' AS target, round(loss, 9) AS loss FROM l UNION ALL SELECT name, 'ai', round(0.9 - 0.1 * r / (1 + r), 9) FROM l")
def runs_with_losses(spark, sf):
    return _with_losses(spark, sf, ("human", "ai")).select("name", "target", F.round("loss", 9).alias("loss"))


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)")
def uncovered_runs(spark, sf):
    """Parts as runs, line items as their losses on targets of return flag and line number."""
    seen = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string")).alias("target"))
    return runs.uncovered(read(spark, sf, "part").select(F.col("p_partkey").alias("name")), seen, "R-7")


@query(STUDY + "SELECT grp, min(name) FILTER (WHERE arm = 'control') AS control, min(name) FILTER (WHERE arm = 'human') AS human, round(ln(max(loss) FILTER (WHERE name = grp || '-5') / max(loss) FILTER (WHERE arm = 'control')), 9) AS change FROM l GROUP BY grp")
def filtering_pairs(spark, sf):
    """Of each group the control and the first human addition, and the change in log loss between them."""
    p = runs.arm_pairs(_with_losses(spark, sf), "control", "human")
    return p.select("grp", F.col("control.name").alias("control"), F.col("human.name").alias("human"), F.round(F.log(F.col("human.loss") / F.col("control.loss")), 9).alias("change"))


@query(STUDY + "SELECT h.name, a.name AS match_name, round(h.loss - a.loss, 9) AS difference FROM (SELECT *, CAST(split_part(name, '-', 3) AS INT) - 4 AS k FROM l WHERE arm = 'human') h JOIN (SELECT *, CAST(split_part(name, '-', 3) AS INT) AS k FROM l WHERE arm = 'ai') a ON a.grp = h.grp AND a.k = h.k")
def matched_additions(spark, sf):
    """Each human addition beside the AI addition of the same amount in its group."""
    rows = _with_losses(spark, sf).withColumn("k", F.element_at(F.split("name", "-"), 3).cast("int"))
    pick = lambda arm, less: rows.where(F.col("arm") == arm).select("name", "grp", "loss", (F.col("k") - less).alias("k"))
    found = runs.matched(pick("human", 4), pick("ai", 0), ["grp", "k"])
    return found.select("name", "match_name", F.round(F.col("loss") - F.col("match_loss"), 9).alias("difference"))


@query(STUDY + "SELECT 'all' AS fold, count(*) AS runs FROM l UNION ALL SELECT 'without_' || CAST(s.size AS VARCHAR), count(*) FROM (SELECT DISTINCT size FROM l) s JOIN l ON l.size <> s.size GROUP BY s.size")
def study_folds(spark, sf):
    return runs.folds(study(spark, sf), "size").groupBy("fold").agg(F.count("*").alias("runs"))


PREDICTED = STUDY + f""", q AS (SELECT l.*, 'effective_data' AS law, {LOSS} AS predicted FROM l UNION ALL SELECT l.*, 'chinchilla', 0.556 + 0.205 * pow(n, -0.36) + 0.418 * pow(d * (1 + r), -0.23) FROM l),
p AS (SELECT q.*, ln(q.loss / c.loss) AS observed_change, ln(q.predicted / c.predicted) AS predicted_change, ln(q.predicted / c.predicted) - ln(q.loss / c.loss) AS paired, q.predicted - q.loss AS absolute FROM q JOIN q c ON c.name = q.control AND c.law = q.law)
"""


def _predictions(spark, sf):
    return fits.predictions(_with_losses(spark, sf), CASES).withColumn("ratio", F.col("added") / F.col("human"))


@query(PREDICTED + "SELECT law, name, round(predicted, 9) AS predicted, round(observed_change, 9) AS observed_change, round(predicted_change, 9) AS predicted_change, round(paired, 9) AS paired, round(absolute, 9) AS absolute FROM p")
def prediction_rows(spark, sf):
    return _predictions(spark, sf).select("law", "name", *[F.round(c, 9).alias(c) for c in ("predicted", "observed_change", "predicted_change", "paired", "absolute")])


@query(PREDICTED + ", s(slice_size, slice_cutoff) AS (VALUES (NULL, NULL), (NULL, 1.0), (10, NULL), (10, 1.0), (22, NULL), (22, 1.0)) SELECT law, CAST(slice_size AS VARCHAR) AS slice_size, CAST(slice_cutoff AS DOUBLE) AS slice_cutoff, count(*) AS runs, count(*) FILTER (WHERE arm = 'ai') AS ai_runs, count(*) FILTER (WHERE arm = 'human') AS human_runs, round(sqrt(avg(paired * paired) FILTER (WHERE arm = 'ai')), 9) AS paired_ai, round(sqrt(avg(paired * paired) FILTER (WHERE arm = 'human')), 9) AS paired_human, round(sqrt(avg(absolute * absolute) FILTER (WHERE arm = 'ai')), 9) AS absolute_ai, round(sqrt(avg(absolute * absolute)), 9) AS absolute_all FROM p JOIN s ON (slice_size IS NULL OR slice_size = size) AND (slice_cutoff IS NULL OR r < slice_cutoff - 1e-10) GROUP BY law, slice_size, slice_cutoff")
def scored_slices(spark, sf):
    """Every law over all sizes, two single ones, all ratios and those below 1."""
    found = runs.slices(_predictions(spark, sf), ["law"], (None, 10, 22), (None, 1.0))
    return found.withColumns({c: F.round(c, 9) for c in ("paired_ai", "paired_human", "absolute_ai", "absolute_all")})


CONTRASTS = STUDY + ", a AS (SELECT *, 0.9 - 0.1 * r / (1 + r) AS ai_loss FROM l), c AS (SELECT a.name, a.grp, k.name AS control, k.loss AS control_human, k.ai_loss AS control_ai, a.loss - k.loss AS delta_human, a.ai_loss - k.ai_loss AS delta_ai FROM a JOIN a k ON k.name = a.control WHERE a.arm = 'ai')\n"


def _contrasts(spark, sf):
    return runs.contrasts(_with_losses(spark, sf, ("human", "ai")), "human", "ai")


@query(CONTRASTS + "SELECT name, control, round(delta_human, 9) AS delta_human, round(delta_ai, 9) AS delta_ai, round(CASE WHEN delta_human > 0 AND delta_ai < 0 THEN delta_human / (delta_human - delta_ai) END, 9) AS critical_share FROM c")
def masking_contrasts(spark, sf):
    return _contrasts(spark, sf).select("name", "control", *[F.round(c, 9).alias(c) for c in ("delta_human", "delta_ai", "critical_share")])


@query(CONTRASTS + ", s(share) AS (VALUES (0.0), (0.05), (0.1), (0.25), (0.5)), q AS (SELECT CAST(share AS DOUBLE) AS share, ((1 - share) * delta_human + share * delta_ai) / ((1 - share) * control_human + share * control_ai) AS reported FROM c, s WHERE delta_human > 0) SELECT share, count(*) AS harmed, CAST(sum(CASE WHEN reported < 0 THEN 1 ELSE 0 END) AS BIGINT) AS masked, round(avg(CASE WHEN reported < 0 THEN 1.0 ELSE 0.0 END), 9) AS masked_share, round(quantile_cont(reported, 0.5), 9) AS median_change FROM q GROUP BY share")
def masking_summary(spark, sf):
    return runs.masking_at(_contrasts(spark, sf), (0.0, 0.05, 0.1, 0.25, 0.5)).withColumns({c: F.round(c, 9) for c in ("masked_share", "median_change")})


@query(CONTRASTS.replace("WITH g", "WITH RECURSIVE g") + ", k AS MATERIALIZED (SELECT list(delta_human) AS dh, list(delta_ai) AS da, list(control_human) AS ch, list(control_ai) AS ca FROM c WHERE delta_human > 0), b AS (SELECT CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, 0 AS step UNION ALL SELECT CASE WHEN med > 0 THEN middle ELSE low END, CASE WHEN med > 0 THEN high ELSE middle END, step + 1 FROM (SELECT b.*, (low + high) / 2 AS middle, list_median(list_transform(range(1, len(dh) + 1), lambda i: ((1 - (low + high) / 2) * dh[i] + (low + high) / 2 * da[i]) / ((1 - (low + high) / 2) * ch[i] + (low + high) / 2 * ca[i]))) AS med FROM b, k WHERE step < 60)) SELECT 'all' AS study, round((low + high) / 2, 9) AS share FROM b WHERE step = 60")
def masking_flip(spark, sf):
    """The AI share at which the median reported change turns, over all harmed runs."""
    return runs.median_flip(_contrasts(spark, sf).withColumn("study", F.lit("all")), "study").withColumn("share", F.round("share", 9))


@query("SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{x}') AS BIGINT) AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def status_histogram(spark, sf):
    return runs.status_counts(read(spark, sf, "events"), ["user_id"], "event_type")


@query(STUDY + "SELECT size, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE split_part(grp, '-', 2) = '{b}') = 0 THEN '--' ELSE CAST(count(*) FILTER (WHERE split_part(grp, '-', 2) = '{b}' AND arm = 'ai') AS VARCHAR) || '+' || CAST(count(*) FILTER (WHERE split_part(grp, '-', 2) = '{b}' AND arm = 'human') AS VARCHAR) END AS b{b}" for b in (0, 1)) + ", CASE WHEN count(*) FILTER (WHERE split_part(grp, '-', 2) NOT IN ('0', '1')) = 0 THEN '--' ELSE CAST(count(*) FILTER (WHERE split_part(grp, '-', 2) NOT IN ('0', '1') AND arm = 'ai') AS VARCHAR) || '+' || CAST(count(*) FILTER (WHERE split_part(grp, '-', 2) NOT IN ('0', '1') AND arm = 'human') AS VARCHAR) END AS other FROM l GROUP BY size")
def run_grid(spark, sf):
    rows = study(spark, sf).withColumn("budget", F.concat(F.lit("b"), F.element_at(F.split("grp", "-"), 2)))
    return runs.grid(rows, "size", "budget", ["b0", "b1"])


@query(STUDY + "(SELECT name, round(loss, 9) AS loss, 'lowest' AS \"end\" FROM l ORDER BY l.loss, name LIMIT 5) UNION ALL (SELECT name, round(loss, 9), 'highest' FROM l ORDER BY l.loss DESC, name LIMIT 5)")
def lowest_and_highest(spark, sf):
    return runs.both_ends(_with_losses(spark, sf).select("name", "loss"), "loss", 5, "name").withColumn("loss", F.round("loss", 9))


@query(STUDY + ", p AS (SELECT a.grp, round(ln(c.loss / a.loss), 9) AS observed_change, round(ln((0.556 + 0.205 * pow(a.n, -0.36) + 0.418 * pow(a.d, -0.23)) / (" + LOSS.replace("(n,", "(a.n,").replace("pow(d ", "pow(a.d ").replace("/ w)", "/ a.w)").replace("0.6 * w ", "0.6 * a.w ").replace("-r ", "-a.r ").replace("pow(t,", "pow(a.t,").replace("(1 + r)", "(1 + a.r)").replace("- r /", "- a.r /") + ")), 9) AS predicted_change FROM l a JOIN l c ON c.name = a.control WHERE a.name = a.grp || '-2') SELECT * FROM p")
def filtering_prediction(spark, sf):
    """What taking the added AI tokens out brings in each group, and what the law predicts."""
    rows = _with_losses(spark, sf)
    pairs = runs.matched(rows.where("name = concat(grp, '-2')"), rows.where("arm = 'control'").select("grp", "loss"), ["grp"])
    found = fits.filtering_prediction(pairs.withColumns({"natural_loss": F.col("loss"), "filtered_loss": F.col("match_loss")}), "effective_data", C4)
    return found.select("grp", F.round("observed_change", 9).alias("observed_change"), F.round("predicted_change", 9).alias("predicted_change"))


@query(STUDY + "SELECT DISTINCT size, CAST(CASE WHEN size <= 6 THEN 262144 WHEN size <= 16 THEN 524288 ELSE 1048576 END AS BIGINT) AS tokens FROM l")
def step_tokens(spark, sf):
    return study(spark, sf).select("size", runs.step_tokens(F.col("size")).alias("tokens")).distinct()


@query("WITH r AS (SELECT o_orderkey AS name, o_custkey AS grp, CAST(floor(o_totalprice / 1000) AS BIGINT) AS steps, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT r.name, r.steps, c.steps AS control_steps FROM r JOIN r c ON c.grp = r.grp AND c.n = 1")
def registered_steps(spark, sf):
    from webloom.plans.studies import runs as orders

    registry = orders(spark, sf).select("name", "grp", "arm", F.floor(F.col("amount") / 1000).cast("long").alias("steps"))
    return runs.run_steps(registry, registry.select("name")).select("name", "steps", "control_steps")


@query(ERRORS_SQL + ", g AS (SELECT target, grp, sum(ours * ours) AS a, sum(theirs * theirs) AS b, count(*) AS n FROM e GROUP BY 1, 2) SELECT target, CAST(count(*) AS INT) AS groups, round(sqrt(sum(b) / sum(n)) - sqrt(sum(a) / sum(n)), 9) AS gap, CAST(sum(CASE WHEN a < b THEN 1 ELSE 0 END) AS INT) AS groups_ours_lower FROM g GROUP BY target")
def group_gap(spark, sf):
    """The part of ``group_bootstrap`` that no draw decides."""
    found = fits.group_bootstrap(errors(spark, sf), ["target"], "grp", "ours", "theirs", draws=200)
    return found.select("target", "groups", F.round("gap", 9).alias("gap"), "groups_ours_lower")


@query()
def group_bootstrap(spark, sf):
    found = fits.group_bootstrap(errors(spark, sf), ["target"], "grp", "ours", "theirs", draws=2_000)
    return found.withColumns({c: F.round(c, 9) for c in ("gap", "low", "high", "p_ours_lower")})


@query()
def fitted_laws(spark, sf):
    """Two laws fitted to the study over all runs and without each size."""
    rows = runs.folds(_with_losses(spark, sf), "size")
    found = fits.fit_bank(rows, ["chinchilla", "effective_data"], n_starts=3, chunk=2)
    return found.select("law", "target", "fold", F.round("cost", 9).alias("cost"), "starts", "converged")


@query()
def left_out_sizes(spark, sf):
    """Paired errors on the sizes that a fit has not seen."""
    rows = _with_losses(spark, sf)
    bank = fits.coefficients(fits.fit_bank(runs.folds(rows, "size").where("fold <> 'all'"), ["chinchilla", "effective_data"], n_starts=2, chunk=3))
    found = fits.left_out_scores(fits.predictions(rows, bank).withColumn("ratio", F.col("added") / F.col("human")), "size")
    return found.select("law", "target", "runs", *[F.round(c, 6).alias(c) for c in ("paired", "paired_low", "paired_high")])


@query()
def equivalent_token_ladder(spark, sf):
    """Effective share of its tokens that a mix is worth, at the AI share that each supplier's balance stands for, with the human tokens of the smallest run."""
    from webloom.functions import solve

    shares = read(spark, sf, "supplier").select("s_suppkey", F.least(F.lit(0.6), F.abs("s_acctbal") / 20_000).alias("share")).repartition(spark.sparkContext.defaultParallelism)
    n, h = F.lit(1e8), F.lit(2e9)
    total = h / (1 - F.col("share"))
    found = shares.withColumn("goal", solve.loss(laws.effective_data_law, C4, n, h, total * F.col("share"))).withColumn("total", total)
    same = solve.compute_equivalent_gain(laws.effective_data_law, C4, n, F.col("goal"), F.col("total"), 0.22315880974511895, 0.5, 200.0, points=256)
    return found.select("s_suppkey", "share", F.round(same["ceg"], 4).alias("ceg"), same["status"].alias("status"))


MEMBERS = "WITH r AS (SELECT o_orderkey AS name, o_custkey AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), a AS (SELECT name, grp, CASE WHEN n = 1 THEN 'control' WHEN n % 4 = 2 THEN 'ai' WHEN n % 4 = 3 THEN 'human' WHEN n % 4 = 0 THEN 'natural' ELSE 'filtered' END AS arm FROM r)\n"


def _armed(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("grp").orderBy("name"))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("grp")).withColumn("n", n)
    return rows.select("name", "grp", F.when(F.col("n") == 1, "control").when(F.col("n") % 4 == 2, "ai").when(F.col("n") % 4 == 3, "human").when(F.col("n") % 4 == 0, "natural").otherwise("filtered").alias("arm"))


@query(MEMBERS + "SELECT a.name, a.arm, CASE WHEN a.arm IN ('ai', 'human') THEN min(b.name) FILTER (WHERE b.arm = 'control') END AS control, CASE a.arm WHEN 'natural' THEN min(b.name) FILTER (WHERE b.arm = 'filtered') WHEN 'filtered' THEN min(b.name) FILTER (WHERE b.arm = 'natural') END AS partner FROM a JOIN a b USING (grp) GROUP BY a.name, a.arm")
def run_catalog(spark, sf):
    return runs.catalog(_armed(spark, sf)).select("name", "arm", "control", "partner")


@query(MEMBERS + "SELECT grp, min(name) FILTER (WHERE arm = 'control') AS control, coalesce(list(name ORDER BY name) FILTER (WHERE arm = 'ai'), []) AS ai, coalesce(list(name ORDER BY name) FILTER (WHERE arm = 'human'), []) AS human FROM a GROUP BY grp")
def arm_members(spark, sf):
    return runs.members(_armed(spark, sf))


@query(STUDY + "SELECT l.name, round(CASE WHEN l.arm = 'human' THEN l.human / c.human - 1 ELSE l.r END, 9) AS fraction, round(100 * (l.loss / c.loss - 1), 9) AS change FROM l JOIN l c ON c.name = l.control")
def added_fractions(spark, sf):
    rows = _with_losses(spark, sf)
    control = rows.where("arm = 'control'").select("control", F.col("human").alias("control_human"), F.col("loss").alias("control_loss"))
    fraction = runs.added_fraction(F.col("arm"), F.col("human"), F.col("added"), F.col("control_human"))
    return rows.join(control, "control").select("name", F.round(fraction, 9).alias("fraction"), F.round(100 * (F.col("loss") / F.col("control_loss") - 1), 9).alias("change"))


@query("SELECT l_shipmode AS law, l_returnflag AS target, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2".replace("l_shipmode", "l_linestatus"))
def unique_fit_cases(spark, sf):
    cases = read(spark, sf, "lineitem").select(F.col("l_linestatus").alias("law"), F.col("l_returnflag").alias("target"), F.col("l_orderkey").alias("first"))
    return runs.unique_cases(cases, ["law", "target"], "first")


def _ablation_sql(name):
    credit, harm, on_data, held = laws.ABLATIONS[name]
    window = f"(0.31 * pow(t, {held.get('rho', -0.9)}) * pow(n, {0.1 if name == 'benefit_exp_size' else 0.0}))"
    worth = CREDITS[credit].replace("w", window) if credit != "none" else "0"
    if "logeta" in held:
        worth = worth.replace("0.6 * ", "1.0 * ", 1)
    data, hurt = f"0.418 * pow(d * (1 + {worth}), -0.23)", f"0.06 * pow(t, {held.get('u', -0.3)}) * pow(n, {held.get('v', -0.1)}) * {HARMS[harm]}"
    return f"round(0.556 + 0.205 * pow(n, -0.36) + {f'({data}) * (1 + {hurt})' if on_data else f'{data} + {hurt}'}, 8) AS {name}"


@query(STUDY + "SELECT name, " + ", ".join(map(_ablation_sql, laws.ABLATIONS)) + " FROM x")
def named_ablations(spark, sf):
    """The sixteen forms of the effective-data law over the study's runs."""
    x, p = laws.Coordinates.of(F.col("parameters"), F.col("human"), F.col("added")), OTHER | {"lam": -0.4}
    return study(spark, sf).select("name", *[F.round(laws.ablation(n, p, x), 8).alias(n) for n in laws.ABLATIONS])
