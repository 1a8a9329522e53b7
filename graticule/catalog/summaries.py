"""Relational summary queries on the fold table and the order frame."""
from __future__ import annotations

from pyspark.sql import functions as F

from graticule.catalog.fixtures import compositions, event_series, fold_facts, order_frame, sql, trajectories
from graticule.catalog.projections import CLASSED, classed
from graticule.catalog.registry import query
from graticule.catalog.spectra import BANDED, ILR_SQL, LOGS, P, coefs
from graticule.functions import arrays as A
from graticule.functions import composition as C
from graticule.operators import spectra as SP
from graticule.operators import summaries as R
from graticule.plans import order_stats as O
from graticule.plans.lineage import shared

Q5 = "quantile_cont({0}, 0.10) AS q10, quantile_cont({0}, 0.25) AS q25, median({0}) AS median, quantile_cont({0}, 0.75) AS q75, quantile_cont({0}, 0.90) AS q90, count({0}) AS n, count(*) FILTER ({0} > 0) AS n_positive"
Q5C = "q10:d q25:d median:d q75:d q90:d n:l n_positive:l"


@query("flagship_composition_by_label", f"label:l coordinate:s {Q5C}", sql("cells", BANDED + f""",
l AS (SELECT map_id, label, ln(greatest(e1 / et, 1e-300)) AS l1, ln(greatest(e2 / et, 1e-300)) AS l2, ln(greatest(e3 / et, 1e-300)) AS l3, ln(greatest(e4 / et, 1e-300)) AS l4, ln(greatest(e5 / et, 1e-300)) AS l5 FROM be),
z AS (SELECT label, {ILR_SQL} FROM l), u AS (SELECT label, 'ilr1' AS coordinate, ilr1 AS v FROM z UNION ALL SELECT label, 'ilr2', ilr2 FROM z UNION ALL SELECT label, 'ilr3', ilr3 FROM z UNION ALL SELECT label, 'ilr4', ilr4 FROM z)
SELECT label, coordinate, {Q5.format('v')} FROM u GROUP BY label, coordinate"""))
def composition_by_label(t):
    """Maps -> residual -> DCT -> five-part composition -> log-ratio coordinates -> quantile summary per label."""
    comp = SP.band_composition(coefs(t))
    z = C.ilr([F.col(f"p_{n}") for n, _, _ in SP.BANDS])
    long = comp.select("label", F.explode(F.array(*[F.struct(F.lit(f"ilr{k}").alias("coordinate"), c.alias("v")) for k, c in enumerate(z, 1)])).alias("e")).select("label", "e.*")
    return R.fold_summary(long, ["label", "coordinate"], "v")


def errors(t):
    return fold_facts(t).withColumn("err", F.col("predicted") - F.col("observed"))


@query("R1_fold_summary", f"target:s model:s {Q5C}", sql("fact_exact", f"e AS (SELECT *, predicted - observed AS err FROM fact) SELECT target, model, {Q5.format('err')} FROM e GROUP BY ALL"))
def fold_summary(t):
    return R.fold_summary(errors(t), ["target", "model"], "err")


@query("R2_paired_delta", f"target:s {Q5C}", sql("fact", f"""d AS (SELECT target, id, max(abs(predicted - observed)) FILTER (model = 'minus') - max(abs(predicted - observed)) FILTER (model = 'full') AS delta FROM fact GROUP BY target, id)
SELECT target, {Q5.format('delta')} FROM d GROUP BY target"""))
def paired_delta(t):
    p = R.paired(errors(t), ["target", "id"], "model", ["full", "minus"], F.abs("err")).withColumn("delta", F.col("minus") - F.col("full"))
    return R.fold_summary(p, ["target"], "delta")


@query("R3_pivot", "o_orderpriority:s f:e o:e p:e", "SELECT o_orderpriority, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS o, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))


@query("R3_unpivot", "o_orderpriority:s status:s total:e", "SELECT o_orderpriority, lower(o_orderstatus) AS status, sum(o_totalprice) AS total FROM orders GROUP BY ALL")
def unpivot(t):
    w = pivot(t)
    return w.select("o_orderpriority", *[F.col(c).alias(c.lower()) for c in ("F", "O", "P")]).unpivot(["o_orderpriority"], ["f", "o", "p"], "status", "total").where("total IS NOT NULL")


SHARES = ", ".join(f"avg((klass = '{k}')::INT) AS q_{k.lower()}" for k in ("INVALID", "OUT", "m1", "m2", "m3"))


@query("R4_class_distribution", "target:s model:s q_invalid:d q_out:d q_m1:d q_m2:d q_m3:d coverage:d n:l low_n:b", sql("fact", f"{CLASSED} SELECT target, model, {SHARES}, avg((klass IN ('m1', 'm2', 'm3'))::INT) AS coverage, count(*) AS n, count(*) < 2900 AS low_n FROM cls GROUP BY ALL"))
def class_distribution(t):
    share = lambda c: F.avg(c.cast("double"))
    return classed(t).groupBy("target", "model").agg(
        *[share(F.col("klass") == k).alias(f"q_{k.lower()}") for k in ("INVALID", "OUT", "m1", "m2", "m3")],
        share(F.col("klass").isin("m1", "m2", "m3")).alias("coverage"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < 2900).alias("low_n"))


BIN = "CASE WHEN observed < 100 THEN 'low' WHEN observed < 300 THEN 'mid' ELSE 'high' END"


@query("R7_residual_diagnostics", "grouping:s level:s n:l mean_obs:d mean_pred:d mae:d rmse:d min_err:d max_err:d", sql("fact", f"""e AS (SELECT target, CAST(fold AS VARCHAR) AS fold, {BIN} AS bin, observed, predicted, predicted - observed AS err FROM fact WHERE model = 'full')
SELECT CASE WHEN grouping(target) = 0 THEN 'target' WHEN grouping(fold) = 0 THEN 'fold' ELSE 'bin' END AS grouping, coalesce(target, fold, bin) AS level, count(*) AS n, avg(observed) AS mean_obs, avg(predicted) AS mean_pred, avg(abs(err)) AS mae,
sqrt(avg(err * err)) AS rmse, min(err) AS min_err, max(err) AS max_err FROM e GROUP BY GROUPING SETS ((target), (fold), (bin))"""))
def residual_diagnostics(t):
    o = F.col("observed")
    e = errors(t).where("model = 'full'").select("target", F.col("fold").cast("string").alias("fold"), F.when(o < 100, "low").when(o < 300, "mid").otherwise("high").alias("bin"), "observed", "predicted", "err")
    g = e.groupingSets([["target"], ["fold"], ["bin"]], "target", "fold", "bin").agg(
        F.grouping("target").alias("gt"), F.grouping("fold").alias("gf"), F.count(F.lit(1)).alias("n"), F.avg("observed").alias("mean_obs"), F.avg("predicted").alias("mean_pred"),
        F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.min("err").alias("min_err"), F.max("err").alias("max_err"))
    return g.withColumn("grouping", F.when(F.col("gt") == 0, "target").when(F.col("gf") == 0, "fold").otherwise("bin")).withColumn("level", F.coalesce("target", "fold", "bin"))


@query("R8_support_scope", "y_min:d y_max:d x1_min:d x1_max:d n:l n_f:l n_o:l n_p:l", sql("ord", "SELECT min(y) AS y_min, max(y) AS y_max, min(x1) AS x1_min, max(x1) AS x1_max, count(*) AS n, count(*) FILTER (role = 'F') AS n_f, count(*) FILTER (role = 'O') AS n_o, count(*) FILTER (role = 'P') AS n_p FROM ord"))
def support_scope(t):
    return order_frame(t).agg(F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x1").alias("x1_min"), F.max("x1").alias("x1_max"), F.count(F.lit(1)).alias("n"),
                              *[F.count_if(F.col("role") == k).alias(f"n_{k.lower()}") for k in "FOP"])


RANKS = "rk AS (SELECT *, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2 AS r1, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2 AS r2, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM ord)"


@query("R9_correlations", "a:s b:s pearson:d spearman:d", sql("ord", RANKS + " SELECT 'x1' AS a, 'x2' AS b, corr(x1, x2) AS pearson, corr(r1, r2) AS spearman FROM rk UNION ALL SELECT 'x1', 'y', corr(x1, y), corr(r1, ry) FROM rk UNION ALL SELECT 'x2', 'y', corr(x2, y), corr(r2, ry) FROM rk"))
def correlations(t):
    return R.correlation_stats(order_frame(t), ["x1", "x2", "y"])


@query("R10_vif", "column_name:s vif:d", sql("ord", """c AS (SELECT corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c FROM ord), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'x1' AS column_name, (1 - c * c) / det AS vif FROM d UNION ALL SELECT 'x2', (1 - b * b) / det FROM d UNION ALL SELECT 'x3', (1 - a * a) / det FROM d"""))
def vif(t):
    return R.vif(order_frame(t), ["x1", "x2", "x3"])


@query("R11_partial_effects", "partial_r2:d beta:d partial_spearman:d n:l", sql("ord", RANKS + """, c AS (SELECT corr(y, x1) AS yx, corr(y, x2) AS yc, corr(x1, x2) AS xc, corr(ry, r1) AS ryx, corr(ry, r2) AS ryc, corr(r1, r2) AS rxc, count(*) AS n FROM rk)
SELECT pow((yx - yc * xc) / sqrt((1 - yc * yc) * (1 - xc * xc)), 2) AS partial_r2, (yx - yc * xc) / (1 - xc * xc) AS beta, (ryx - ryc * rxc) / sqrt((1 - ryc * ryc) * (1 - rxc * rxc)) AS partial_spearman, n FROM c"""))
def partial_effects(t):
    return R.partial_effects(order_frame(t), "y", "x1", ["x2"])


@query("R12_within_bin_spearman", "bin:l rho:d n:l", sql("ord", """e AS (SELECT quantile_cont(y, 0.25) AS a, median(y) AS b, quantile_cont(y, 0.75) AS c FROM ord), q AS (SELECT x1, x2, CASE WHEN y <= a THEN 0 WHEN y <= b THEN 1 WHEN y <= c THEN 2 ELSE 3 END AS bin FROM ord, e),
r AS (SELECT bin, rank() OVER (PARTITION BY bin ORDER BY x1) + (count(*) OVER (PARTITION BY bin, x1) - 1) / 2 AS r1, rank() OVER (PARTITION BY bin ORDER BY x2) + (count(*) OVER (PARTITION BY bin, x2) - 1) / 2 AS r2 FROM q)
SELECT bin, corr(r1, r2) AS rho, count(*) AS n FROM r GROUP BY bin"""))
def within_bin_spearman(t):
    from graticule.plans.scalars import one_row
    df = order_frame(t)
    q = one_row(O.quantiles(df, [], "y", {"a": 0.25, "b": 0.5, "c": 0.75}))
    b = df.withColumn("bin", F.when(F.col("y") <= q["a"], 0).when(F.col("y") <= q["b"], 1).when(F.col("y") <= q["c"], 2).otherwise(3)).select("bin", "x1", "x2")
    return R.spearman(b, ["bin"], "x1", "x2", "rho").join(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin")


@query("R13_component_weights", "id:l weight:d", sql("ord", "SELECT id, 1000.0 / ((SELECT count(DISTINCT grp) FROM ord) * count(*) OVER (PARTITION BY grp)) AS weight FROM ord"))
def component_weights(t):
    """Weights times 1000, so that six decimals show them."""
    return R.component_weights(order_frame(t), "grp").select("id", (F.col("weight") * 1000).alias("weight"))


@query("R14_target_statistics", "coordinate:s mean:d scale:d pooled:d", sql("comp", f"""l AS (SELECT user_id, {LOGS} FROM comp), z AS (SELECT 1.0::DOUBLE * (1 + user_id % 3) AS w, {ILR_SQL} FROM l),
u AS (SELECT 'ilr1' AS coordinate, w, ilr1 AS v FROM z UNION ALL SELECT 'ilr2', w, ilr2 FROM z UNION ALL SELECT 'ilr3', w, ilr3 FROM z UNION ALL SELECT 'ilr4', w, ilr4 FROM z),
s AS (SELECT coordinate, sum(w * v) / sum(w) AS mean, greatest(sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2), 1e-12) AS var FROM u GROUP BY coordinate)
SELECT coordinate, mean, sqrt(var) AS scale, sqrt(avg(var) OVER ()) AS pooled FROM s"""))
def target_statistics(t):
    z = C.ilr(P())
    w = 1.0 + F.col("user_id") % 3
    long = compositions(t).select(w.alias("w"), F.explode(F.array(*[F.struct(F.lit(f"ilr{k}").alias("coordinate"), c.alias("v")) for k, c in enumerate(z, 1)])).alias("e")).select("w", "e.*")
    mean = F.sum(F.col("w") * F.col("v")) / F.sum("w")
    var = F.greatest(F.sum(F.col("w") * F.col("v") * F.col("v")) / F.sum("w") - mean * mean, F.lit(1e-12))
    s = long.groupBy("coordinate").agg(mean.alias("mean"), var.alias("var"))
    return s.withColumn("pooled", F.sqrt(s.agg(F.avg("var").alias("p")).scalar())).withColumn("scale", F.sqrt("var"))


@query("R15_per_row_risk", "id:l model:s risk:d", sql("fact", "s AS (SELECT var_pop(observed) AS v, var_pop(ln(1 + observed)) AS lv FROM fact WHERE model = 'full') SELECT id, model, (pow(observed - predicted, 2) / v + pow(ln(1 + observed) - ln(1 + greatest(predicted, 0)), 2) / lv) / 2 AS risk FROM fact, s"))
def per_row_risk(t):
    """Squared errors of two target blocks, each in its own scale, averaged over blocks."""
    from graticule.plans.scalars import one_row
    f = fold_facts(t)
    s = one_row(f.where("model = 'full'").agg(F.var_pop("observed").alias("v"), F.var_pop(F.log1p("observed")).alias("lv")))
    a = F.pow(F.col("observed") - F.col("predicted"), 2) / s["v"]
    b = F.pow(F.log1p("observed") - F.log1p(F.greatest("predicted", F.lit(0.0))), 2) / s["lv"]
    return f.select("id", "model", ((a + b) / 2).alias("risk"))


@query("R16_oof_metrics", "target:s model:s mae:d rmse:d q2:d coverage:d n_components:l n_rows:l", sql("fact", """p AS (SELECT target, model, grp, avg(abs(observed - predicted)) AS a, avg(pow(observed - predicted, 2)) AS s, avg(pow(observed - train_null, 2)) AS z, count(*) AS n FROM fact GROUP BY ALL)
SELECT target, model, avg(a) AS mae, sqrt(avg(s)) AS rmse, 1 - avg(s) / avg(z) AS q2, 1.0 AS coverage, count(*) AS n_components, sum(n) AS n_rows FROM p GROUP BY ALL"""))
def oof_metrics(t):
    return R.oof_metrics(fold_facts(t), ["target", "model"], "grp", "observed", "predicted", "train_null")


@query("R17_component_balanced_mse", "model:s mse:d mae:d n_components:l", sql("fact", "p AS (SELECT model, grp, avg(pow(observed - predicted, 2)) AS s, avg(abs(observed - predicted)) AS a FROM fact GROUP BY ALL) SELECT model, avg(s) AS mse, avg(a) AS mae, count(*) AS n_components FROM p GROUP BY model"))
def component_balanced_mse(t):
    return R.balanced_mse(fold_facts(t), ["model"], "grp", F.col("observed") - F.col("predicted"))


@query("R18_variability_table", "role:s sd:d iqr:d sentinel_delta:d share_below:d", sql("ord", """s AS (SELECT role, stddev_pop(y) AS sd, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, median(y) AS med FROM ord GROUP BY role), d AS (SELECT abs(max(y) FILTER (id = 0) - max(y) FILTER (id = 1)) AS delta FROM ord)
SELECT ord.role, any_value(sd) AS sd, any_value(iqr) AS iqr, any_value(delta) AS sentinel_delta, avg((abs(y - med) < delta)::INT) AS share_below FROM ord JOIN s ON s.role = ord.role, d GROUP BY ord.role"""))
def variability_table(t):
    """Spread per role and the share of ordinary deviations below one repeat pair's difference."""
    df = order_frame(t)
    q = O.quantiles(df, ["role"], "y", {"q25": 0.25, "med": 0.5, "q75": 0.75})
    delta = df.agg(F.abs(F.max(F.when(F.col("id") == 0, F.col("y"))) - F.max(F.when(F.col("id") == 1, F.col("y")))).alias("d")).scalar()
    j = df.join(q, "role").withColumn("below", (F.abs(F.col("y") - F.col("med")) < delta).cast("double"))
    return j.groupBy("role").agg(F.stddev_pop("y").alias("sd"), (F.first("q75") - F.first("q25")).alias("iqr"), F.avg("below").alias("share_below")).withColumn("sentinel_delta", delta)


@query("R19_pair_coverage", "fold:l role:s n_rows:l n_components:l n_component_pairs:l n_row_pairs:l state:s", sql("ord", """s AS (SELECT grp % 5 AS fold, role, grp, count(*) AS n FROM ord GROUP BY ALL)
SELECT fold, role, sum(n) AS n_rows, count(*) AS n_components, count(*) * (count(*) - 1) // 2 AS n_component_pairs, (sum(n) * sum(n) - sum(n * n)) // 2 AS n_row_pairs, CASE WHEN count(*) >= 2 THEN 'VALID' ELSE 'NOT_ESTIMABLE' END AS state FROM s GROUP BY ALL"""))
def pair_coverage(t):
    return R.pair_coverage(order_frame(t).withColumn("fold", F.col("grp") % 5), "fold", "role", "grp")


@query("R20_condition_rollup", "l_suppkey:l mean_q:d spread:d n:l levels:s", "SELECT l_suppkey, avg(l_quantity) AS mean_q, stddev_pop(l_quantity) AS spread, count(*) AS n, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS levels FROM lineitem GROUP BY l_suppkey")
def condition_rollup(t):
    """collect_set keeps one entry per level, so its size follows the number of levels, not of rows."""
    return t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean_q"), F.stddev_pop("l_quantity").alias("spread"), F.count(F.lit(1)).alias("n"),
                                               F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), "|").alias("levels"))


@query("R21_auroc", "auc:d rank_biserial:d n_pos:l n_neg:l", """WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id)), s AS (SELECT sum(r) FILTER (quality = 1) AS sr, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM r)
SELECT (sr - p * (p + 1) / 2) / (p * q) AS auc, 2 * (sr - p * (p + 1) / 2) / (p * q) - 1 AS rank_biserial, p AS n_pos, q AS n_neg FROM s""")
def auroc(t):
    return R.auroc(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id"), [], "n_chars", "quality")


@query("R22_regression_metrics", "fold:l r2:d mae:d rmse:d rho:d n:l", sql("fact", """f AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY observed) + (count(*) OVER (PARTITION BY fold, observed) - 1) / 2 AS ro, rank() OVER (PARTITION BY fold ORDER BY predicted) + (count(*) OVER (PARTITION BY fold, predicted) - 1) / 2 AS rp FROM fact WHERE model = 'full')
SELECT fold, 1 - sum(pow(observed - predicted, 2)) / (var_pop(observed) * count(*)) AS r2, avg(abs(observed - predicted)) AS mae, sqrt(avg(pow(observed - predicted, 2))) AS rmse, corr(ro, rp) AS rho, count(*) AS n FROM f GROUP BY fold"""))
def regression_metrics(t):
    return R.regression_metrics(fold_facts(t).where("model = 'full'"), ["fold"], "observed", "predicted")


@query("R23_q2_train_null", "model:s fold:l q2:d n:l", sql("fact", "SELECT model, fold, 1 - sum(pow(observed - predicted, 2)) / sum(pow(observed - train_null, 2)) AS q2, count(*) AS n FROM fact GROUP BY ALL"))
def q2_train_null(t):
    return R.q2(fold_facts(t), ["model", "fold"], "observed", "predicted", "train_null")


@query("R23_q2_ilr", "q2:d", sql("comp", f"l AS (SELECT user_id, {LOGS} FROM comp), z AS (SELECT {ILR_SQL} FROM l), m AS (SELECT avg(ilr1) AS a, avg(ilr2) AS b, avg(ilr3) AS c, avg(ilr4) AS d FROM z) SELECT 1 - sum(0.25 * (pow(ilr1 - a, 2) + pow(ilr2 - b, 2) + pow(ilr3 - c, 2) + pow(ilr4 - d, 2))) / sum(pow(ilr1 - a, 2) + pow(ilr2 - b, 2) + pow(ilr3 - c, 2) + pow(ilr4 - d, 2)) AS q2 FROM z, m"))
def q2_ilr(t):
    """Composition skill in log-ratio space: a predictor halfway between null and truth scores 0.75."""
    from graticule.plans.scalars import one_row
    z = compositions(t).select(*[c.alias(f"z{k}") for k, c in enumerate(C.ilr(P()), 1)])
    m = one_row(z.agg(*[F.avg(f"z{k}").alias(f"z{k}") for k in range(1, 5)]))
    long = z.select(F.explode(F.array(*[F.struct(F.col(f"z{k}").alias("observed"), ((F.col(f"z{k}") + m[f"z{k}"]) / 2).alias("predicted"), m[f"z{k}"].alias("null")) for k in range(1, 5)])).alias("e")).select("e.*")
    return R.q2(long, [], "observed", "predicted", "null")


@query("R24_validate_oof", "model:s fold:l n_rows:l n_expected:l n_duplicate:l n_bad:l ok:b", sql("fact", """n AS (SELECT grp % 5 AS fold, count(*) AS n FROM ord GROUP BY 1) SELECT model, fold, count(*) AS n_rows, any_value(n) AS n_expected, 0 AS n_duplicate, count(*) FILTER (predicted IS NULL OR NOT isfinite(predicted)) AS n_bad,
count(*) = any_value(n) AND count(*) FILTER (predicted IS NULL OR NOT isfinite(predicted)) = 0 AS ok FROM fact JOIN n USING (fold) GROUP BY model, fold"""))
def validate_oof(t):
    f = fold_facts(t)
    bad = F.col("predicted").isNull() | F.isnan("predicted") | (F.abs("predicted") == float("inf"))
    per = f.groupBy("model", "fold", "id").agg(F.count(F.lit(1)).alias("c"), F.count_if(bad).alias("b"))
    got = per.groupBy("model", "fold").agg(F.sum("c").alias("n_rows"), F.count_if(F.col("c") > 1).alias("n_duplicate"), F.sum("b").alias("n_bad"))
    want = order_frame(t).groupBy((F.col("grp") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("n_expected"))
    return got.join(want, "fold").withColumn("ok", (F.col("n_rows") == F.col("n_expected")) & (F.col("n_duplicate") == 0) & (F.col("n_bad") == 0))


IQR = "tq AS (SELECT k AS fold, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM range(5) AS g(k) JOIN ord ON grp % 5 <> k GROUP BY k)"


def atlas(t):
    df = order_frame(t).withColumn("f", F.col("grp") % 5).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("f <> fold")
    iqr = O.quantiles(df, ["fold"], "y", {"a": 0.25, "b": 0.75}).select("fold", (F.col("b") - F.col("a")).alias("iqr"))
    return fold_facts(t).join(iqr, "fold").withColumn("norm_err", F.abs(F.col("observed") - F.col("predicted")) / F.col("iqr"))


@query("R25_error_atlas", "id:l model:s target:s norm_err:d", sql("fact_exact", IQR + " SELECT id, model, target, abs(observed - predicted) / iqr AS norm_err FROM fact JOIN tq USING (fold)"))
def error_atlas(t):
    return atlas(t)


@query("R26_hotspots", "target:s n_both:l n_any:l jaccard:d rho:d", sql("fact", IQR + """, e AS (SELECT target, id, max(abs(observed - predicted) / iqr) FILTER (model = 'full') AS a, max(abs(observed - predicted) / iqr) FILTER (model = 'minus') AS b FROM fact JOIN tq USING (fold) GROUP BY target, id),
q AS (SELECT target, quantile_cont(a, 0.9) AS qa, quantile_cont(b, 0.9) AS qb FROM e GROUP BY target), r AS (SELECT e.*, a >= qa AS ha, b >= qb AS hb, rank() OVER (PARTITION BY e.target ORDER BY a) + (count(*) OVER (PARTITION BY e.target, a) - 1) / 2 AS ra,
rank() OVER (PARTITION BY e.target ORDER BY b) + (count(*) OVER (PARTITION BY e.target, b) - 1) / 2 AS rb FROM e JOIN q ON q.target = e.target) SELECT target, count(*) FILTER (ha AND hb) AS n_both, count(*) FILTER (ha OR hb) AS n_any, count(*) FILTER (ha AND hb) / count(*) FILTER (ha OR hb) AS jaccard, corr(ra, rb) AS rho FROM r GROUP BY target"""))
def hotspots(t):
    e = shared(R.paired(atlas(t), ["target", "id"], "model", ["full", "minus"], F.col("norm_err")))
    q = O.quantiles(e, ["target"], "full", {"qa": 0.9}).join(O.quantiles(e, ["target"], "minus", {"qb": 0.9}), "target")
    h = e.join(q, "target").withColumns({"ha": F.col("full") >= F.col("qa"), "hb": F.col("minus") >= F.col("qb")})
    g = h.groupBy("target").agg(F.count_if(F.col("ha") & F.col("hb")).alias("n_both"), F.count_if(F.col("ha") | F.col("hb")).alias("n_any"))
    return g.withColumn("jaccard", F.col("n_both") / F.col("n_any")).join(R.spearman(e, ["target"], "full", "minus", "rho"), "target")


@query("R27_sensitivity_label", "target:s delta:d label:s", sql("fact", """m AS (SELECT target, median(abs(observed - predicted)) FILTER (model = 'minus') - median(abs(observed - predicted)) FILTER (model = 'full') AS delta FROM fact GROUP BY target)
SELECT target, delta, CASE WHEN abs(delta) < 70 THEN 'stable' WHEN abs(delta) < 85 THEN 'moderate' ELSE 'strong' END AS label FROM m"""))
def sensitivity_label(t):
    e = errors(t).withColumn("ae", F.abs("err"))
    m = O.median(e, ["target", "model"], "ae", "m")
    w = R.paired(m, ["target"], "model", ["full", "minus"], F.col("m")).withColumn("delta", F.col("minus") - F.col("full"))
    return w.withColumn("label", F.when(F.abs("delta") < 70, "stable").when(F.abs("delta") < 85, "moderate").otherwise("strong"))


@query("R28_raw_vs_repaired", "label:l n:l mean_raw:d mean_repaired:d corr_arms:d mean_cosine:d", """WITH e AS (SELECT vec_id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS a, [greatest(CAST(v AS DOUBLE), -0.15) FOR v IN embedding] AS b FROM embeddings),
m AS (SELECT label, list_avg(a) AS ra, list_avg(b) AS rb, list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS c FROM e) SELECT label, count(*) AS n, avg(ra) AS mean_raw, avg(rb) AS mean_repaired, corr(ra, rb) AS corr_arms, avg(c) AS mean_cosine FROM m GROUP BY label""")
def raw_vs_repaired(t):
    e = t.embeddings.select("label", F.transform("embedding", lambda v: v.cast("double")).alias("a")).withColumn("b", F.transform("a", lambda v: F.greatest(v, F.lit(-0.15))))
    a, b = F.col("a"), F.col("b")
    m = e.select("label", A.array_mean(a).alias("ra"), A.array_mean(b).alias("rb"), (A.dot(a, b) / F.sqrt(A.dot(a, a) * A.dot(b, b))).alias("c"))
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("ra").alias("mean_raw"), F.avg("rb").alias("mean_repaired"), F.corr("ra", "rb").alias("corr_arms"), F.avg("c").alias("mean_cosine"))


@query("R31_ordering_accuracy", "target:s model:s n_pairs:l accuracy:d", sql("fact", """pr AS (SELECT min(id) OVER (PARTITION BY target, grp) AS i, id AS j, target AS t FROM fact WHERE model = 'full'),
j AS (SELECT a.target, a.model, sign(a.observed - b.observed) AS o, sign(a.predicted - b.predicted) AS p FROM pr JOIN fact a ON a.id = i JOIN fact b ON b.id = j AND b.target = a.target AND b.model = a.model)
SELECT target, model, count(*) AS n_pairs, avg((o = p)::INT) AS accuracy FROM j WHERE o <> 0 GROUP BY ALL"""))
def ordering_accuracy(t):
    """Pairs: the first order of a customer and target with each of the others."""
    f = fold_facts(t)
    of = f.where("model = 'full'").groupBy("target", "grp").agg(F.min("id").alias("i"))
    pairs = f.where("model = 'full'").select("target", "grp", F.col("id").alias("j")).join(of, ["target", "grp"])
    return R.ordering_accuracy(f, pairs, ["target", "model"], "id", "observed", "predicted")


@query("R32_outcome_free_scope", "o_orderkey:l c_mktsegment:s log_dose:d support:s", """SELECT o_orderkey, c_mktsegment, ln(1 + q) AS log_dose, CASE WHEN q IS NULL THEN 'no_lines' WHEN q < 50 THEN 'low' ELSE 'supported' END AS support
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def outcome_free_scope(t):
    """Only columns that are not outcomes enter the scope table."""
    outcome = {"o_totalprice", "c_acctbal"}
    o, c = t.orders, t.customer.withColumnRenamed("c_custkey", "o_custkey")
    o = o.select(*[x for x in o.columns if x not in outcome])
    c = c.select(*[x for x in c.columns if x not in outcome])
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    j = o.join(c, "o_custkey").join(q, "o_orderkey", "left")
    return j.withColumn("log_dose", F.log1p("q")).withColumn("support", F.when(F.col("q").isNull(), "no_lines").when(F.col("q") < 50, "low").otherwise("supported"))
