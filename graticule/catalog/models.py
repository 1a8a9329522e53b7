"""Fold, model and interpretation queries on the order frame (x1, x2, x3 -> y)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graticule.catalog.fixtures import fold_facts, order_frame, sql
from graticule.catalog.registry import query
from graticule.functions import arrays as A
from graticule.functions.hashing import draw_key
from graticule.operators import fitted as M
from graticule.operators import folds as K
from graticule.operators import forests as T
from graticule.operators import linear as L
from graticule.operators import permutations as N
from graticule.operators import resampling as B
from graticule.operators import targets as Y
from graticule.plans import order_stats as O
from graticule.plans.lineage import cut, shared

X = ("x1", "x2", "x3")


def frame(t):
    return order_frame(t).withColumn("fold", F.col("grp") % 5).withColumn("inner", F.floor(F.col("grp") / 5) % 3)


def cols(names):
    return [F.col(n) for n in names]


SIZES = "sz AS (SELECT grp, count(*) AS n FROM ord GROUP BY grp)"


def serp(order: str, k: int, part: str = "") -> str:
    return f"(CASE WHEN ((row_number() OVER ({part} ORDER BY {order}) - 1) // {k}) % 2 = 0 THEN (row_number() OVER ({part} ORDER BY {order}) - 1) % {k} ELSE {k - 1} - (row_number() OVER ({part} ORDER BY {order}) - 1) % {k} END)"


@query("M1_group_kfold", "grp:l n:l fold:l", sql("ord", f"{SIZES} SELECT grp, n, {serp('n DESC, md5(CAST(grp AS VARCHAR))', 5)} AS fold FROM sz"))
def group_kfold(t):
    return K.group_folds(order_frame(t), "grp", 5)


@query("M2_balanced_group_folds", "grp:l n:l fold:l", sql("ord", f"sz AS (SELECT grp, count(*) AS n, count(*) FILTER (role = 'F') AS a, count(*) FILTER (role = 'O') AS b FROM ord GROUP BY grp) SELECT grp, n, {serp('n DESC, a DESC, b DESC, md5(CAST(grp AS VARCHAR))', 5)} AS fold FROM sz"))
def balanced_group_folds(t):
    return K.group_folds(order_frame(t), "grp", 5, [F.col("role") == "F", F.col("role") == "O"])


@query("M3_group_shuffle_split", "rep:l grp:l is_test:b", sql("ord", "g AS (SELECT DISTINCT grp FROM ord), n AS (SELECT count(*) AS n FROM g) SELECT rep, grp, row_number() OVER (PARTITION BY rep ORDER BY md5('5|' || rep || '|' || grp), grp) <= ceil(n * 0.2::DOUBLE) AS is_test FROM g, n, range(4) AS r(rep)"))
def group_shuffle_split(t):
    return K.shuffled_holdouts(order_frame(t), "grp", 4, 0.2, 5)


@query("M4_check_fold_contract", "identity:s n_leaks:l", sql("fact", "a AS (SELECT grp FROM fact GROUP BY grp HAVING min(fold) <> max(fold)), b AS (SELECT target FROM fact GROUP BY target HAVING min(fold) <> max(fold)) SELECT 'grp' AS identity, count(*) AS n_leaks FROM a UNION ALL SELECT 'target', count(*) FROM b"))
def check_fold_contract(t):
    v = K.fold_violations(fold_facts(t), "fold", ["grp", "target"]).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    names = fold_facts(t).select(F.explode(F.array(F.lit("grp"), F.lit("target"))).alias("identity")).distinct()
    return names.join(v, "identity", "left").select("identity", F.coalesce("n", F.lit(0)).alias("n_leaks"))


@query("M5_nested_splits", "outer:l grp:l inner:l", sql("ord", f"{SIZES}, f AS (SELECT grp, n, {serp('n DESC, md5(CAST(grp AS VARCHAR))', 5)} AS fold FROM sz) SELECT o AS outer, grp, {serp('n DESC, md5(CAST(grp AS VARCHAR))', 3, 'PARTITION BY o')} AS inner FROM f, range(5) AS g(o) WHERE fold <> o".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"')))
def nested_splits(t):
    return K.nested_folds(order_frame(t), "grp", 5, 3)


@query("M6_fold_assignment_table", "variant:s fold:l role:s n:l id_sum:l", sql("ord", "SELECT variant, k AS fold, CASE WHEN (CASE variant WHEN 'grp' THEN grp ELSE id END) % 5 = k THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(id) AS id_sum FROM ord, range(5) AS g(k), (VALUES ('grp'), ('id')) AS v(variant) GROUP BY ALL"))
def fold_assignment_table(t):
    rows = order_frame(t).select("id", "grp", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")).withColumn("variant", F.explode(F.array(F.lit("grp"), F.lit("id"))))
    own = F.when(F.col("variant") == "grp", F.col("grp")).otherwise(F.col("id")) % 5
    return rows.withColumn("role", F.when(own == F.col("fold"), "test").otherwise("train")).groupBy("variant", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


FS = "r AS (SELECT *, grp % 5 AS fold, (grp // 5) % 3 AS inn FROM ord), fd AS (SELECT DISTINCT fold AS k FROM r)"
TR1 = FS + ", tr AS (SELECT k, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) AS cxy FROM fd JOIN r ON r.fold <> k GROUP BY k)"
TR2 = FS + """, tr AS (SELECT k, count(*) AS n, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(y) AS my, corr(x1, x2) AS r12, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2 FROM fd JOIN r ON r.fold <> k GROUP BY k),
cf AS (SELECT k, my, m1, m2, s1, s2, (c1 * (1 + a / n) - r12 * c2) / (pow(1 + a / n, 2) - r12 * r12) AS b1, (c2 * (1 + a / n) - r12 * c1) / (pow(1 + a / n, 2) - r12 * r12) AS b2 FROM tr, (SELECT 10.0::DOUBLE AS a))"""


def ridge_fits(t, names=("x1", "x2"), alphas=(10.0,), designs=None):
    s = L.moments(frame(t), ["fold"], cols(names), F.col("y"))
    return L.fit(L.leave_out(s, [], "fold"), designs or {"all": list(range(len(names)))}, list(alphas))


@query("M7_ridge_coefficients", "fold:l intercept:d b1:d b2:d sse:e", sql("ord", TR2 + ", c AS (SELECT k AS fold, my - b1 / s1 * m1 - b2 / s2 * m2 AS intercept, b1 / s1 AS b1, b2 / s2 AS b2 FROM cf) SELECT c.fold, any_value(intercept) AS intercept, any_value(c.b1) AS b1, any_value(c.b2) AS b2, sum(pow(y - intercept - c.b1 * x1 - c.b2 * x2, 2)) AS sse FROM c JOIN r ON r.fold = c.fold GROUP BY c.fold"))
def ridge_coefficients(t):
    return ridge_fits(t).select("fold", "intercept", F.get("coef", F.lit(0)).alias("b1"), F.get("coef", F.lit(1)).alias("b2"), "sse")


@query("M7_ridge_oof", "id:l fold:l predicted:d", sql("ord", TR2 + " SELECT id, fold, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 AS predicted FROM r JOIN cf ON k = fold"))
def ridge_oof(t):
    return frame(t).join(ridge_fits(t).select("fold", "intercept", "coef"), "fold").select("id", "fold", L.predict(cols(("x1", "x2"))).alias("predicted"))


def inner(t, names=("x1",)):
    s = L.moments(frame(t), ["fold", "inner"], cols(names), F.col("y"))
    return L.inner_scores(s, "fold", "inner", {"all": list(range(len(names)))}, L.ALPHA_GRID, 5)


@query("M8_select_alpha_inner", "fold:l alpha:d mse:d", sql("ord", FS + """, al AS (SELECT pow(10, -3 + g * 0.5) AS a FROM range(13) AS s(g)), ii AS (SELECT DISTINCT inn AS j FROM r),
tr AS (SELECT k, j, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) AS cxy FROM fd, ii JOIN r ON r.fold <> k AND r.inn <> j GROUP BY k, j),
sc AS (SELECT tr.k, tr.j, a, avg(pow(y - my - (cxy / sx) / (1 + a / n) * (x1 - mx) / sx, 2)) AS mse FROM tr JOIN r ON r.fold <> tr.k AND r.inn = tr.j, al GROUP BY tr.k, tr.j, a), av AS (SELECT k, a, avg(mse) AS mse FROM sc GROUP BY k, a)
SELECT k AS fold, a AS alpha, mse FROM av QUALIFY row_number() OVER (PARTITION BY k ORDER BY mse, a) = 1"""))
def select_alpha_inner(t):
    s = inner(t)
    best = L.select_alpha(s, ["fold"])
    return s.join(best, ["fold", "alpha"]).select("fold", "alpha", "mse")


def nested_sql(targets: dict[str, str], scorer: str) -> str:
    """Nested choice of the penalty for x1, x2 and two targets, with the closed form of two standardised features."""
    def stats(where, by):
        pairs = ", ".join(f"avg({t}) AS m{t}, covar_pop(x1, {t}) / stddev_pop(x1) AS p{t}, covar_pop(x2, {t}) / stddev_pop(x2) AS q{t}" for t in targets)
        return f"SELECT {by}, count(*) AS n, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, corr(x1, x2) AS r12, {pairs} FROM {where} GROUP BY {by}"
    error = lambda t: f"pow({t} - m{t} - ((p{t} * (1 + a / n) - r12 * q{t}) * (x1 - m1) / s1 + (q{t} * (1 + a / n) - r12 * p{t}) * (x2 - m2) / s2) / (pow(1 + a / n, 2) - r12 * r12), 2)"
    sse, ss0 = " + ".join(error(t) for t in targets), " + ".join(f"pow({t} - m{t}, 2)" for t in targets)
    q2, mse = f"1 - sum({sse}) / sum({ss0})", f"avg({sse}) / {len(targets)}"
    names = ", ".join(f"{c} AS {t}" for t, c in targets.items())
    # scores that agree to TIE are a tie, which the smallest penalty wins
    near = f"s >= max(s) OVER (PARTITION BY k) - {Y.TIE}" if scorer == "log_ratio_q2" else f"s <= min(s) OVER (PARTITION BY k) * (1 + {Y.TIE})"
    return sql("ord", FS + f""", al AS (SELECT pow(10, -3 + g * 0.5) AS a FROM range(13) AS s(g)), z AS (SELECT fold, inn, x1, x2, {names} FROM r), ii AS (SELECT DISTINCT inn AS j FROM z),
tr AS ({stats('fd, ii JOIN z ON z.fold <> k AND z.inn <> j', 'k, j')}), sc AS (SELECT tr.k, tr.j, a, {q2 if scorer == 'log_ratio_q2' else mse} AS s FROM tr JOIN z ON z.fold <> tr.k AND z.inn = tr.j, al GROUP BY tr.k, tr.j, a),
av AS (SELECT k, a, avg(s) AS s FROM sc GROUP BY k, a), near AS (SELECT k, a, s FROM av QUALIFY {near}), best AS (SELECT k, a, s FROM near QUALIFY row_number() OVER (PARTITION BY k ORDER BY a) = 1), ow AS ({stats('fd JOIN z ON z.fold <> k', 'k')})
SELECT k AS fold, a AS alpha, any_value(s) AS inner_score, {mse} AS test_mse, {q2} AS test_q2 FROM ow JOIN best USING (k) JOIN z ON z.fold = k GROUP BY k, a""")


def nested(t, targets, scorer, weight=None):
    return Y.nested(frame(t), "fold", "inner", cols(("x1", "x2")), targets, {"both": [0, 1]}, 5, scorer, weight=weight)


NESTED = "fold:l alpha:d inner_score:d test_mse:d test_q2:d"


@query("M8_nested_two_targets", NESTED, nested_sql({"ya": "y / 100", "yb": "x3"}, "multi_mse"))
def nested_two_targets(t):
    """One penalty per outer fold for two targets, by their mean squared error over inner folds."""
    return nested(t, [F.col("y") / 100, F.col("x3")], "multi_mse")


LOG_RATIOS = {"za": "(ln(1 + x3) - ln(1 + x2)) / sqrt(2)", "zb": "(ln(1 + x3) + ln(1 + x2) - 2 * ln(y)) / sqrt(6)"}


@query("M8_nested_log_ratio", NESTED, nested_sql(LOG_RATIOS, "log_ratio_q2"))
def nested_log_ratio(t):
    """Targets are the two log-ratio coordinates of a three-part composition; the inner score is their joint Q2."""
    return nested(t, [F.expr(e) for e in LOG_RATIOS.values()], "log_ratio_q2")


@query("M8_select_alpha_q2", "fold:l alpha:d")
def select_alpha_q2(t):
    return L.select_alpha(inner(t, X), ["fold"], "q2")


def weighted(t):
    f = frame(t)
    sizes = f.groupBy("grp").agg(F.count(F.lit(1)).alias("nc"))
    return f.join(sizes, "grp")


@query("M9_weighted_ridge", "fold:l intercept:d b1:d", sql("ord", FS + """, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp) AS w FROM r), s AS (SELECT k, count(*) AS n, sum(w) AS sw, sum(w * x1) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x1 * x1) / sum(w) AS xx, sum(w * x1 * y) / sum(w) AS xy FROM fd JOIN w ON w.fold <> k GROUP BY k)
SELECT k AS fold, my - mx * (xy - mx * my) / (xx - mx * mx) / (1 + 1.0::DOUBLE / n) AS intercept, (xy - mx * my) / (xx - mx * mx) / (1 + 1.0::DOUBLE / n) AS b1 FROM s"""))
def weighted_ridge(t):
    s = L.moments(weighted(t), ["fold"], [F.col("x1")], F.col("y"), 1.0 / F.col("nc"))
    return L.fit(L.leave_out(s, [], "fold"), {"all": [0]}, [1.0]).select("fold", "intercept", F.get("coef", F.lit(0)).alias("b1"))


@query("M9_gam", "fold:l intercept:d n_test:l rmse:d")
def gam(t):
    """Component-weighted additive model: four spline columns per feature with fold-specific knots, penalised as they are."""
    w = weighted(t)
    bounds = L.training_bounds(w, "fold", ["x1", "x2"], 5)
    rows = w.withColumn("outer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).join(bounds, "outer").withColumn("part", F.when(F.col("fold") == F.col("outer"), "test").otherwise("train"))
    basis = [b for c in ("x1", "x2") for b in L.spline_basis(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))]
    s = L.moments(rows, ["outer", "part"], basis, F.col("y"), 1.0 / F.col("nc"))
    pick = lambda p, c: F.first(F.when(F.col("part") == p, F.col(c)), ignorenulls=True).alias(f"{c}_{p}")
    splits = s.groupBy(F.col("outer").alias("fold")).agg(*[pick(p, c) for p in ("train", "test") for c in ("m", "n")])
    f = L.fit(splits, {"all": list(range(8))}, [1.0], standardise=False)
    return f.join(splits.select("fold", F.get("m_test", F.lit(0)).alias("mass")), "fold").select("fold", "intercept", "n_test", F.sqrt(F.col("sse") / F.col("mass")).alias("rmse"))


@query("M10_cross_fit_feature", "id:l dhat:d", sql("ord", FS + ", tr AS (SELECT j, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) AS cxy FROM (SELECT DISTINCT inn AS j FROM r) i JOIN r ON r.inn <> j GROUP BY j) SELECT id, my + (cxy / sx) / (1 + 1.0::DOUBLE / n) * (x1 - mx) / sx AS dhat FROM r JOIN tr ON j = inn"))
def cross_fit_feature(t):
    f = frame(t)
    fits = L.fit(L.leave_out(L.moments(f, ["inner"], [F.col("x1")], F.col("y")), [], "inner"), {"all": [0]}, [1.0]).select("inner", "intercept", "coef")
    return f.join(fits, "inner").select("id", L.predict([F.col("x1")]).alias("dhat"))


@query("M11_residual_stack", "fold:l q2_first:d q2_stack:d n:l")
def residual_stack(t):
    """Second layer fitted on first-layer inner out-of-fold residuals, for every outer fold."""
    f = frame(t)
    rows = f.withColumn("outer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    train = rows.where("fold <> outer")
    first_inner = L.fit(L.leave_out(L.moments(train, ["outer", "inner"], [F.col("x1")], F.col("y")), ["outer"], "inner"), {"u": [0]}, [1.0]).select("outer", "inner", "intercept", "coef")
    resid = train.join(first_inner, ["outer", "inner"]).withColumn("res", F.col("y") - L.predict([F.col("x1")])).drop("intercept", "coef")
    second = L.fit(L.whole(L.moments(resid, ["outer"], cols(("x2", "x3")), F.col("res"))), {"b": [0, 1]}, [1.0]).select("outer", F.col("intercept").alias("i2"), F.col("coef").alias("c2"))
    first = L.fit(L.leave_out(L.moments(f, ["fold"], [F.col("x1")], F.col("y")), [], "fold"), {"u": [0]}, [1.0]).select(F.col("fold").alias("outer"), "intercept", "coef")
    null = train.groupBy("outer").agg(F.avg("y").alias("null"))
    test = rows.where("fold = outer").join(first, "outer").join(second, "outer").join(null, "outer")
    p1 = L.predict([F.col("x1")])
    p2 = p1 + L.predict(cols(("x2", "x3")), "c2", "i2")
    sq = lambda e: F.sum((F.col("y") - e) * (F.col("y") - e))
    return test.groupBy(F.col("outer").alias("fold")).agg((1 - sq(p1) / sq(F.col("null"))).alias("q2_first"), (1 - sq(p2) / sq(F.col("null"))).alias("q2_stack"), F.count(F.lit(1)).alias("n"))


def _ml_cv(t, make, names=X, features_from=None):
    """Fit one pyspark.ml regressor per fold on the other folds; predictions stay distributed."""
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=list(names), outputCol="features").transform((features_from or weighted)(t).withColumn("w", 1.0 / F.col("nc")))
    out = None
    for k in range(5):
        model = make().fit(data.where(F.col("fold") != k))
        p = model.transform(data.where(F.col("fold") == k)).select("id", "grp", "fold", F.col("y").alias("observed"), F.col("prediction").alias("predicted"))
        out = p if out is None else out.unionByName(p)
    return out


@query("M12_tree_regressor_cv", "fold:l n:l mae:d rmse:d")
def tree_regressor_cv(t):
    from pyspark.ml.regression import RandomForestRegressor
    make = lambda: RandomForestRegressor(featuresCol="features", labelCol="y", weightCol="w", numTrees=20, maxDepth=5, bootstrap=False, featureSubsetStrategy="onethird", seed=7)
    e = F.col("observed") - F.col("predicted")
    return _ml_cv(t, make).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


DESIGNS = {"U": ["x1", "x3"], "P": ["x2"], "M": ["x2", "x4"], "U+P": ["x1", "x3", "x2"], "U+M": ["x1", "x3", "x2", "x4"]}


def tree_errors(t, trees: int):
    """id, grp, fold, design, observed, predicted, train_null of component-weighted trees of every design, held out by fold."""
    w = weighted(t).withColumns({"x3": F.col("x3").cast("double"), "x4": F.ascii("prio").cast("double"), "w": 1.0 / F.col("nc")})
    forest = T.grow(w, ["x1", "x2", "x3", "x4"], "y", "fold", DESIGNS, trees, depth=5, least=3, seed=12, weight=F.col("w"))
    told = T.held_out(w, forest, "fold", ["id", "grp", "nc", "fold", "y"]).withColumnRenamed("y", "observed")
    null = L.leave_out(L.moments(w, ["fold"], [], F.col("y"), F.col("w")), [], "fold").select("fold", (F.get("m_train", F.lit(1)) / F.get("m_train", F.lit(0))).alias("train_null"))
    return told.join(null, "fold")


@query("M12_matched_trees", "design:s n:l components:l mae:d rmse:d q2:d")
def matched_trees(t, trees: int = 20):
    """The same budget of extremely randomised trees on five designs; component-balanced errors of held-out predictions."""
    e, w = F.col("observed") - F.col("predicted"), 1.0 / F.col("nc")
    null = F.col("observed") - F.col("train_null")
    per = tree_errors(t, trees).groupBy("design", "grp").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v * w).alias(a) for a, v in (("w", F.lit(1.0)), ("mae", F.abs(e)), ("se", e * e), ("s0", null * null))])
    share = lambda c: F.sum(c) / F.sum("w")
    return per.groupBy("design").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("components"), share("mae").alias("mae"), F.sqrt(share("se")).alias("rmse"), (1 - F.sum("se") / F.sum("s0")).alias("q2"))


@query("M12_matched_trees_delta", "design:s mean:d low:d high:d components:l")
def matched_trees_delta(t):
    """Per component, squared error of each design less that of the widest; bootstrap over components."""
    e2 = F.pow(F.col("observed") - F.col("predicted"), 2)
    per = shared(tree_errors(t, 10).groupBy("grp", "design").agg(F.avg(e2).alias("e")))
    widest = per.where("design = 'U+M'").select("grp", F.col("e").alias("base"))
    d = shared(per.where("design <> 'U+M'").join(widest, "grp").select("design", "grp", (F.col("e") - F.col("base")).alias("d"), F.lit(1.0).alias("one")))
    stats = B.resampled_means(d, "grp", 100, 12, "d", "one", by=["design"])
    mean = d.groupBy("design").agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("components"))
    return B.interval(stats, ["design"], 0.95).join(mean, "design")


@query("M13_tabular_cv", "model:s n:l mae_mean:d mae_std:d r2:d")
def tabular_cv(t):
    """Two repeats of hashed three-fold CV with median imputation; mean prediction over repeats."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    f = order_frame(t).withColumn("x1", F.when(F.col("id") % 17 != 0, F.col("x1"))).withColumn("x3", F.col("x3").cast("double"))
    f = cut(f.select("id", "grp", *X, "y"))  # one row per order, read by every fit and prediction
    makers = {"linear": lambda: LinearRegression(featuresCol="features", labelCol="y", regParam=0.01), "gbt": lambda: GBTRegressor(featuresCol="features", labelCol="y", maxIter=5, maxDepth=3, seed=3)}
    out = None
    for rep in range(2):
        data = f.withColumn("fold", F.conv(F.substring(draw_key(71, rep, F.col("grp")), 1, 6), 16, 10).cast("long") % 3)
        for name, make in makers.items():
            for k in range(3):
                stages = [Imputer(inputCols=list(X), outputCols=[f"i_{c}" for c in X], strategy="median"), VectorAssembler(inputCols=[f"i_{c}" for c in X], outputCol="features"), make()]
                p = Pipeline(stages=stages).fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)).select(F.lit(name).alias("model"), F.lit(rep).alias("rep"), "id", "y", "prediction")
                out = p if out is None else out.unionByName(p)
    per_rep = out.groupBy("model", "rep").agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae")).groupBy("model").agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"))
    mean = out.groupBy("model", "id").agg(F.avg("prediction").alias("p"), F.first("y").alias("y"))
    r2 = mean.groupBy("model").agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))
    return per_rep.join(r2, "model")


@query("M14_mean_baseline", "fold:l null_mean:d weighted_null:d", sql("ord", FS + ", w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp) AS w FROM r) SELECT k AS fold, avg(y) AS null_mean, sum(w * y) / sum(w) AS weighted_null FROM fd JOIN w ON w.fold <> k GROUP BY k"))
def mean_baseline(t):
    w = weighted(t)
    plain = L.leave_out(L.moments(w, ["fold"], [], F.col("y")), [], "fold").select("fold", (F.get("m_train", F.lit(1)) / F.get("m_train", F.lit(0))).alias("null_mean"))
    wt = L.leave_out(L.moments(w, ["fold"], [], F.col("y"), 1.0 / F.col("nc")), [], "fold").select("fold", (F.get("m_train", F.lit(1)) / F.get("m_train", F.lit(0))).alias("weighted_null"))
    return plain.join(wt, "fold")


Q2_1 = "1 - sum(pow(y - my - (cxy / sx) / (1 + 1.0::DOUBLE / n) * (x1 - mx) / sx, 2)) / sum(pow(y - my, 2))"
Q2_2 = Q2_1.replace("x1", "x2").replace("mx", "m2").replace("sx", "s2").replace("cxy", "c2")
TR12 = FS + ", tr AS (SELECT k, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, covar_pop(x1, y) AS cxy, avg(x2) AS m2, stddev_pop(x2) AS s2, covar_pop(x2, y) AS c2, avg(y) AS my FROM fd JOIN r ON r.fold <> k GROUP BY k)"


@query("M15_ablation", "fold:l design:s q2:d", sql("ord", TR12 + f" SELECT k AS fold, 'x1_only' AS design, {Q2_1} AS q2 FROM tr JOIN r ON fold = k GROUP BY k UNION ALL SELECT k, 'x2_only', {Q2_2} FROM tr JOIN r ON fold = k GROUP BY k"))
def ablation(t):
    f = ridge_fits(t, ("x1", "x2"), (1.0,), {"x1_only": [0], "x2_only": [1]})
    return f.withColumn("q2", 1 - F.col("sse") / F.col("ss0"))


@query("M15_ablation_groups", "removed:s median_drop:d")
def ablation_groups(t):
    """Skill lost when a feature or feature group is left out; every sub-model comes from the same sums."""
    designs = {"full": [0, 1, 2], "x1": [1, 2], "x2": [0, 2], "x3": [0, 1], "x1+x2": [2]}
    f = ridge_fits(t, X, (1.0,), designs).withColumn("q2", 1 - F.col("sse") / F.col("ss0"))
    full = f.where("design = 'full'").select("fold", F.col("q2").alias("q2_full"))
    d = f.where("design <> 'full'").join(full, "fold").select(F.col("design").alias("removed"), (F.col("q2_full") - F.col("q2")).alias("drop_q2"))
    return O.median(d, ["removed"], "drop_q2", "median_drop")


@query("M16_arm_runner", "arm:s fold:l q2:d", sql("ord", "r0 AS (SELECT *, grp % 5 AS fold FROM ord), r AS (SELECT 'all' AS arm, * FROM r0 UNION ALL SELECT 'formal', * FROM r0 WHERE role = 'F' UNION ALL SELECT 'low', * FROM r0 WHERE y < 400), fd AS (SELECT DISTINCT arm, fold AS k FROM r), "
    "tr AS (SELECT fd.arm, k, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) AS cxy FROM fd JOIN r ON r.arm = fd.arm AND r.fold <> k GROUP BY fd.arm, k) SELECT tr.arm, k AS fold, " + Q2_1 + " AS q2 FROM tr JOIN r ON r.arm = tr.arm AND r.fold = k GROUP BY tr.arm, k"))
def arm_runner(t):
    """Arms are filters kept as an array of labels per row, so all arms share one scan."""
    arms = F.array_compact(F.array(F.lit("all"), F.when(F.col("role") == "F", "formal"), F.when(F.col("y") < 400, "low")))
    s = L.moments(frame(t).withColumn("arm", F.explode(arms)), ["arm", "fold"], [F.col("x1")], F.col("y"))
    return L.fit(L.leave_out(s, ["arm"], "fold"), {"x1": [0]}, [1.0]).select("arm", "fold", (1 - F.col("sse") / F.col("ss0")).alias("q2"))


@query("M17_local_vs_global", "stratum:s fold:l q2_local:d q2_global:d", sql("ord", "r AS (SELECT *, grp % 5 AS fold, role AS st FROM ord), fd AS (SELECT DISTINCT st, fold AS k FROM r), tr AS (SELECT fd.st, k, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) AS cxy FROM fd JOIN r ON r.st = fd.st AND r.fold <> k GROUP BY fd.st, k), "
    "tg AS (SELECT k, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) AS cxy FROM (SELECT DISTINCT k FROM fd) d JOIN r ON r.fold <> k GROUP BY k), lo AS (SELECT tr.st, k, " + Q2_1 + " AS q FROM tr JOIN r ON r.st = tr.st AND r.fold = k GROUP BY tr.st, k), gl AS (SELECT r.st, k, " + Q2_1 + " AS q FROM tg JOIN r ON r.fold = k GROUP BY r.st, k) SELECT lo.st AS stratum, lo.k AS fold, lo.q AS q2_local, gl.q AS q2_global FROM lo JOIN gl ON gl.st = lo.st AND gl.k = lo.k"))
def local_vs_global(t):
    s = L.moments(frame(t), ["role", "fold"], [F.col("x1")], F.col("y"))
    local = L.leave_out(s, ["role"], "fold")
    g = L.moments(frame(t), ["fold"], [F.col("x1")], F.col("y"))
    glob = local.select("role", "fold", "m_test", "n_test").join(L.leave_out(g, [], "fold").select("fold", "m_train", "n_train"), "fold")
    q = lambda d, n: L.fit(d, {"x1": [0]}, [1.0]).select(F.col("role").alias("stratum"), "fold", (1 - F.col("sse") / F.col("ss0")).alias(n))
    return q(local, "q2_local").join(q(glob, "q2_global"), ["stratum", "fold"])


Q2_12 = """tb AS (SELECT k, count(*) AS n, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(y) AS my, corr(x1, x2) AS r12, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2 FROM fd JOIN r ON r.fold <> k GROUP BY k),
cb AS (SELECT k, my, m1, m2, s1, s2, (c1 * (1 + 1.0::DOUBLE / n) - r12 * c2) / (pow(1 + 1.0::DOUBLE / n, 2) - r12 * r12) AS b1, (c2 * (1 + 1.0::DOUBLE / n) - r12 * c1) / (pow(1 + 1.0::DOUBLE / n, 2) - r12 * r12) AS b2 FROM tb),
qab AS (SELECT k, 1 - sum(pow(y - my - b1 * (x1 - m1) / s1 - b2 * (x2 - m2) / s2, 2)) / sum(pow(y - my, 2)) AS q FROM cb JOIN r ON fold = k GROUP BY k)"""


@query("M18_conditioning_bridge", "direction:s median_delta:d", sql("ord", TR12 + ", " + Q2_12 + f""", qa AS (SELECT k, {Q2_1} AS q FROM tr JOIN r ON fold = k GROUP BY k), qb AS (SELECT k, {Q2_2} AS q FROM tr JOIN r ON fold = k GROUP BY k)
SELECT 'x2_given_x1' AS direction, median(qab.q - qa.q) AS median_delta FROM qab JOIN qa USING (k) UNION ALL SELECT 'x1_given_x2', median(qab.q - qb.q) FROM qab JOIN qb USING (k)"""))
def conditioning_bridge(t):
    """Extra skill of one observable given the other, both ways."""
    f = ridge_fits(t, ("x1", "x2"), (1.0,), {"a": [0], "b": [1], "ab": [0, 1]}).withColumn("q2", 1 - F.col("sse") / F.col("ss0"))
    w = f.groupBy("fold").agg(*[F.max(F.when(F.col("design") == d, F.col("q2"))).alias(d) for d in ("a", "b", "ab")])
    long = w.select(F.explode(F.array(F.struct(F.lit("x2_given_x1").alias("direction"), (F.col("ab") - F.col("a")).alias("d")), F.struct(F.lit("x1_given_x2").alias("direction"), (F.col("ab") - F.col("b")).alias("d")))).alias("e")).select("e.*")
    return O.median(long, ["direction"], "d", "median_delta")


@query("M19_permutation_importance", "feature:s importance:d")
def permutation_importance(t):
    """Mean loss of held-out skill when one feature is reassigned inside each test fold by hashed order."""
    f = frame(t)
    fits = ridge_fits(t, X, (1.0,)).select("fold", "intercept", "coef", "ss0", "sse")
    names = {k: c for k, c in enumerate(X)}
    out = None
    for k, c in names.items():
        moved = B.permuted(f.select("fold", "id", F.col(c).cast("double").alias(c)), ["fold"], "id", c, 3, 80 + k)
        rows = moved.join(f.drop(c), ["fold", "id"]).join(fits, "fold")
        e = F.col("y") - L.predict(cols(X))
        d = rows.groupBy("fold", "rep").agg((F.sum(e * e) / F.first("ss0") - F.first("sse") / F.first("ss0")).alias("d"))
        one = d.agg(F.avg("d").alias("importance")).select(F.lit(c).alias("feature"), "importance")
        out = one if out is None else out.unionByName(one)
    return out


LIN = FS + ", g AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM ord)"


def line(t):
    """In-sample straight-line model used by the curve queries."""
    s = L.moments(order_frame(t), [], [F.col("x1")], F.col("y"))
    return L.fit(L.whole(s), {"x1": [0]}, [0.0]).select(F.struct("intercept", "coef").alias("f"))


@query("M20_partial_dependence", "q:d x:d response:d", sql("ord", LIN + ", e AS (SELECT 0.1 AS q, quantile_cont(x1, 0.1) AS x FROM ord UNION ALL SELECT 0.5, median(x1) FROM ord UNION ALL SELECT 0.9, quantile_cont(x1, 0.9) FROM ord) SELECT q, x, a + b * x AS response FROM e, g"))
def partial_dependence(t):
    """Response on a quantile grid; a linear response averaged over rows equals the response at row means."""
    q = O.quantiles(order_frame(t), [], "x1", {"0.1": 0.1, "0.5": 0.5, "0.9": 0.9})
    grid = q.select(F.explode(F.array(*[F.struct(F.lit(p).alias("q"), F.col(f"`{p}`").alias("x")) for p in (0.1, 0.5, 0.9)])).alias("e")).select("e.*")
    m = line(t).scalar()
    return grid.select("q", "x", (m["intercept"] + F.get(m["coef"], F.lit(0)) * F.col("x")).alias("response"))


@query("M21_ale_curve", "bin:l n:l effect:d", sql("ord", LIN + """, e AS (SELECT min(x1) AS e0, quantile_cont(x1, 0.25) AS e1, median(x1) AS e2, quantile_cont(x1, 0.75) AS e3, max(x1) AS e4 FROM ord),
d AS (SELECT CASE WHEN x1 <= e1 THEN 0 WHEN x1 <= e2 THEN 1 WHEN x1 <= e3 THEN 2 ELSE 3 END AS bin, b * (CASE WHEN x1 <= e1 THEN e1 - e0 WHEN x1 <= e2 THEN e2 - e1 WHEN x1 <= e3 THEN e3 - e2 ELSE e4 - e3 END) AS d FROM ord, e, g),
m AS (SELECT bin, count(*) AS n, avg(d) AS d FROM d GROUP BY bin), c AS (SELECT bin, n, sum(d) OVER (ORDER BY bin) AS acc FROM m) SELECT bin, n, acc - sum(acc * n) OVER () / sum(n) OVER () AS effect FROM c"""))
def ale_curve(t):
    from graticule.plans.scalars import one_row
    df = order_frame(t)
    e = one_row(O.quantiles(df, [], "x1", {f"e{k}": k / 4 for k in range(5)}))
    rows = df.select("x1").withColumn("m", line(t).scalar()).withColumn("e", e)
    x = F.col("x1")
    b = F.when(x <= F.col("e.e1"), 0).when(x <= F.col("e.e2"), 1).when(x <= F.col("e.e3"), 2).otherwise(3)
    edges = F.array(*[F.col(f"e.e{k}") for k in range(5)])
    pred = lambda v: F.col("m.intercept") + F.get("m.coef", F.lit(0)) * v
    rows = rows.withColumn("bin", b).withColumn("d", pred(F.get(edges, F.col("bin") + 1)) - pred(F.get(edges, F.col("bin"))))
    per = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("d"))
    packed = per.agg(F.array_sort(F.collect_list(F.struct("bin", "n", "d"))).alias("p"))  # one entry per bin
    acc = packed.select("p", F.transform("p", lambda s: F.aggregate(F.filter("p", lambda o: o["bin"] <= s["bin"]), F.lit(0.0), lambda a, o: a + o["d"])).alias("acc"))
    mean = A.dot(F.col("acc"), F.transform("p", lambda s: s["n"].cast("double"))) / A.array_sum(F.transform("p", lambda s: s["n"].cast("double")))
    return acc.withColumn("mean", mean).select("mean", F.explode(F.arrays_zip("p", "acc")).alias("z")).select("z.p.bin", "z.p.n", (F.col("z.acc") - F.col("mean")).alias("effect"))


def label_moments(t):
    v = t.embeddings.select((F.col("label") % 5).alias("fold"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return B.cluster_moments(v, "fold", "e", 64)


@query("M22_fold_pca", "fold:l evr:d angle_deg:d test_rmse:d")
def fold_pca(t):
    """Training-only PCA per fold: explained share, angle to the full-data plane, held-out reconstruction error."""
    s = label_moments(t).select(F.col("fold").cast("long").alias("fold"), "m", F.lit(0.0).alias("n"))
    splits = L.leave_out(s, [], "fold")

    def run(batches):
        for pdf in batches:
            out = []
            for fold, tr, te in zip(pdf["fold"], pdf["m_train"], pdf["m_test"]):
                tr, te = np.asarray(tr), np.asarray(te)
                (v, evr), (full, _) = B._eigen(tr, 64, 3), B._eigen(tr + te, 64, 3)
                mu = tr[1:65] / tr[0]
                n, sm, q = te[0], te[1:65], te[65:].reshape(64, 64)
                c = q - np.outer(sm, mu) - np.outer(mu, sm) + n * np.outer(mu, mu)
                rest = max(np.trace(c) - np.trace(v.T @ c @ v), 0.0)
                out.append((int(fold), float(evr[:3].sum()), B.largest_angle(v, full), float(np.sqrt(rest / (n * 64)))))
            yield pd.DataFrame(out, columns=["fold", "evr", "angle_deg", "test_rmse"])
    return splits.mapInPandas(run, "fold long, evr double, angle_deg double, test_rmse double")


@query("M23_conditional_subset_stability", "subset:s p50:d p95:d eigengap:d call:s")
def conditional_subset_stability(t):
    """Bootstrap angle quantiles of label subsets against all labels, with the eigengap and a call."""
    v = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("cluster", F.col("vec_id") % 40)
    out = None
    for name, keep in (("all", F.lit(True)), ("even", F.col("label") % 2 == 0), ("odd", F.col("label") % 2 == 1)):
        sub = v.where(keep)
        a = B.pca_bootstrap_angles(sub, "cluster", "e", 64, 3, 15, 91)
        q = O.quantiles(a, [], "angle_deg", {"p50": 0.5, "p95": 0.95})
        whole_ = B.cluster_moments(sub.withColumn("one", F.lit(0)), "one", "e", 64)

        def gap(batches):
            for pdf in batches:
                for m in pdf["m"]:
                    _, evr = B._eigen(np.asarray(m), 64, 3)
                    yield pd.DataFrame({"eigengap": [float(evr[2] - evr[3])]})
        one = q.withColumn("eigengap", whole_.select("m").mapInPandas(gap, "eigengap double").scalar()).withColumn("subset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("call", F.when(F.col("p95") < 30, "stable").when(F.col("p50") < 45, "moderate").otherwise("unstable"))


CAND = "cand AS (SELECT fold AS g, pr AS param, abs(observed - predicted * pr) AS loss, NOT (id % 97 = 0 AND pr > 1.1) AS valid FROM fact, (VALUES (0.9), (1.0), (1.1), (1.2)) AS p(pr) WHERE model = 'full')"
HELD = CAND + """, gm AS (SELECT g, param, avg(loss) AS m, bool_and(valid) AS ok FROM cand GROUP BY g, param), hs AS (SELECT k AS held, param, median(m) AS score FROM range(5) AS h(k) JOIN gm ON g <> k GROUP BY k, param HAVING bool_and(ok)),
sel AS (SELECT held, arg_min(param, struct_pack(s := score, p := param)) AS param FROM hs GROUP BY held)"""


def candidates(t):
    p = F.explode(F.array(*[F.lit(x) for x in (0.9, 1.0, 1.1, 1.2)]))
    c = fold_facts(t).where("model = 'full'").withColumn("param", p)
    return c.select(F.col("fold").alias("g"), "param", F.abs(F.col("observed") - F.col("predicted") * F.col("param")).alias("loss"), (~((F.col("id") % 97 == 0) & (F.col("param") > 1.1))).alias("valid"))


def held_out_choice(t):
    """Parameter chosen on the other groups: median of group means, only parameters valid everywhere, ties to the smaller."""
    gm = candidates(t).groupBy("g", "param").agg(F.avg("loss").alias("m"), F.bool_and("valid").alias("ok"))
    spread = gm.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("g <> held")
    s = O.median(spread, ["held", "param"], "m", "score").join(spread.groupBy("held", "param").agg(F.bool_and("ok").alias("ok")), ["held", "param"]).where("ok")
    return s.groupBy("held").agg(F.min_by("param", F.struct("score", "param")).alias("param"))


@query("M24_loo_group_select", "held:l param:d held_loss:d", sql("fact", HELD + " SELECT held, any_value(sel.param) AS param, avg(loss) AS held_loss FROM sel JOIN cand ON g = held AND cand.param = sel.param GROUP BY held"))
def loo_group_select(t):
    c = held_out_choice(t)
    return c.join(candidates(t).withColumnRenamed("g", "held"), ["held", "param"]).groupBy("held").agg(F.first("param").alias("param"), F.avg("loss").alias("held_loss"))


@query("M25_admissible_distribution", "held:l q_invalid:d q_small:d q_large:d n:l", sql("fact", HELD.replace("pr > 1.1", "pr > 0.85") .replace("HAVING bool_and(ok)", "") + " SELECT held, avg((NOT valid)::INT) AS q_invalid, avg((valid AND loss < 50)::INT) AS q_small, avg((valid AND loss >= 50)::INT) AS q_large, count(*) AS n FROM sel JOIN cand ON g = held AND cand.param = sel.param GROUP BY held"))
def admissible_distribution(t):
    """Failed held-out rows form their own class instead of being dropped."""
    p = F.explode(F.array(*[F.lit(x) for x in (0.9, 1.0, 1.1, 1.2)]))
    c = fold_facts(t).where("model = 'full'").withColumn("param", p).select(
        F.col("fold").alias("g"), "param", F.abs(F.col("observed") - F.col("predicted") * F.col("param")).alias("loss"), (F.col("id") % 97 != 0).alias("valid"))
    gm = c.groupBy("g", "param").agg(F.avg("loss").alias("m"))
    spread = gm.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("g <> held")
    best = O.median(spread, ["held", "param"], "m", "score").groupBy("held").agg(F.min_by("param", F.struct("score", "param")).alias("param"))
    share = lambda x: F.avg(x.cast("double"))
    return best.join(c.withColumnRenamed("g", "held"), ["held", "param"]).groupBy("held").agg(
        share(~F.col("valid")).alias("q_invalid"), share(F.col("valid") & (F.col("loss") < 50)).alias("q_small"), share(F.col("valid") & (F.col("loss") >= 50)).alias("q_large"), F.count(F.lit(1)).alias("n"))


BENT = "o AS (SELECT id, x1, x2, y, x2 * x2 AS s2 FROM ord), mo AS (SELECT avg(x1) AS m1, avg(s2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(s2) AS v2, covar_pop(x1, s2) AS c12, covar_pop(x1, y) AS c1, covar_pop(s2, y) AS c2 FROM o), bt AS (SELECT (c1 * v2 - c12 * c2) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c12 * c1) / (v1 * v2 - c12 * c12) AS b2, * FROM mo), md AS (SELECT my - b1 * m1 - b2 * m2 AS a, b1, b2, m1, m2 FROM bt)"


def bent(t):
    """In-sample model of x1 and the square of x2."""
    s = L.moments(order_frame(t), [], M.squares(("x1", "x2")), F.col("y"))
    return M.linear_models(L.fit(L.whole(s), {"bent": [0, 3]}, [0.0]), 4, [0, 3], "square")


@query("M20_pdp_over_rows", "feature:s k:l x:d response:d n:l", sql("ord", BENT + """, p AS (SELECT k, 0.05 + k * 0.1 AS q FROM range(10) AS g(k)), gr AS (SELECT DISTINCT 'x1' AS feature, x FROM (SELECT unnest(quantile_cont(x1, [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95])) AS x FROM o) UNION ALL SELECT DISTINCT 'x2', x FROM (SELECT unnest(quantile_cont(x2, [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95])) AS x FROM o)),
nn AS (SELECT count(*) AS n FROM o) SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS k, x, CASE feature WHEN 'x1' THEN a + b1 * x + b2 * m2 ELSE a + b1 * m1 + b2 * x * x END AS response, n FROM gr, md, nn"""))
def pdp_over_rows(t):
    """Predictions of a fitted model averaged over all rows, on quantile grids of both columns."""
    df = order_frame(t)
    return M.partial_dependence(df, bent(t), ("x1", "x2"), M.quantile_points(df, ("x1", "x2"), [0.05 + 0.1 * k for k in range(10)]))


@query("M21_ale_bins", "feature:s bin:l lo:d hi:d n:l effect:d", sql("ord_exact", BENT + """, qs AS (SELECT quantile_cont(x1, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS q1, quantile_cont(x2, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS q2 FROM o),
ed AS (SELECT feature, list_sort(list_distinct(q)) AS e FROM (SELECT 'x1' AS feature, q1 AS q FROM qs UNION ALL SELECT 'x2', q2 FROM qs)), v AS (SELECT 'x1' AS feature, x1 AS x FROM o UNION ALL SELECT 'x2', x2 FROM o),
b AS (SELECT feature, least(len(list_filter(e, lambda z: z <= x)), len(e) - 1) AS b, e FROM v JOIN ed USING (feature)), d AS (SELECT feature, b - 1 AS bin, e[b] AS lo, e[b + 1] AS hi, CASE feature WHEN 'x1' THEN b1 * (e[b + 1] - e[b]) ELSE b2 * (e[b + 1] * e[b + 1] - e[b] * e[b]) END AS d FROM b, md),
m AS (SELECT feature, bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n, avg(d) AS d FROM d GROUP BY feature, bin), c AS (SELECT *, sum(d) OVER (PARTITION BY feature ORDER BY bin) AS acc FROM m) SELECT feature, bin, lo, hi, n, acc - sum(acc * n) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS effect FROM c"""))
def ale_bins(t):
    """Accumulated local effects of a fitted model between quantile edges; tasks hand on sums and counts per bin."""
    return M.accumulated_effects(order_frame(t, exact=True), bent(t), ("x1", "x2"), 8)


@query("M20_additive_curves", "feature:s k:l x:d response:d")
def additive_curves(t):
    """Spline model along 25 quantiles of each column, the other columns at their mean."""
    df = order_frame(t)
    return M.response_at_means(df, M.additive_model(df, X, "y"), X, M.quantile_points(df, X, np.linspace(0.05, 0.95, 25)))


def forest_model(t):
    """A small forest of pyspark.ml with its nodes exported into the model table."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    df = order_frame(t).withColumn("x3", F.col("x3").cast("double"))
    data = VectorAssembler(inputCols=list(X), outputCol="features").transform(df)
    model = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=10, maxDepth=4, seed=5).fit(data)
    return M.model_table(t.spark, [{"model": "forest", "kind": "trees", "intercept": 0.0, "trees": M.exported_trees(model)}])


@query("M20_forest_curves", "curve:s feature:s k:l x:d response:d n:l")
def forest_curves(t):
    """Partial dependence and accumulated effects of a forest; columns of few values use them as their grid."""
    df, forest = order_frame(t), forest_model(t)
    p = M.partial_dependence(df, forest, X, M.quantile_points(df, X, np.linspace(0.05, 0.95, 12), few=12)).select(F.lit("pdp").alias("curve"), "feature", "k", "x", "response", "n")
    a = M.accumulated_effects(df, forest, X, 8).select(F.lit("ale").alias("curve"), "feature", F.col("bin").alias("k"), ((F.col("lo") + F.col("hi")) / 2).alias("x"), F.col("effect").alias("response"), "n")
    return p.unionByName(a)


IMPORTANCE = 10


@query("M19_importance", "feature:s fold:l q2_base:d q2_perm:d importance:d", sql("ord", TR2.replace("10.0::DOUBLE", "1.0::DOUBLE") + f""", rows AS (SELECT fold AS g, id, x1, x2, y, row_number() OVER (PARTITION BY fold ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM r), {N.duck_partners("rows", 83, IMPORTANCE)},
mv AS (SELECT b.rep, a.g, a.y, a.x1, a.x2, s.x1 AS z1, s.x2 AS z2 FROM bij b JOIN rows a USING (g, i) JOIN rows s ON s.g = b.g AND s.i = b.v), pr AS (SELECT g, rep, y, my, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 AS p0, my + b1 * (z1 - m1) / s1 + b2 * (x2 - m2) / s2 AS p1, my + b1 * (x1 - m1) / s1 + b2 * (z2 - m2) / s2 AS p2 FROM mv JOIN cf ON cf.k = g),
q AS (SELECT g, rep, 1 - sum(pow(y - p0, 2)) / sum(pow(y - my, 2)) AS q0, 1 - sum(pow(y - p1, 2)) / sum(pow(y - my, 2)) AS q1, 1 - sum(pow(y - p2, 2)) / sum(pow(y - my, 2)) AS q2 FROM pr GROUP BY g, rep)
SELECT 'x1' AS feature, g AS fold, avg(q0) AS q2_base, avg(q1) AS q2_perm, avg(q0) - avg(q1) AS importance FROM q GROUP BY g UNION ALL SELECT 'x2', g, avg(q0), avg(q2), avg(q0) - avg(q2) FROM q GROUP BY g""").replace("WITH ", "WITH RECURSIVE ", 1))
def importance(t):
    """Ten computed permutations per test fold; one join of rows x replicates serves all columns."""
    fits = M.linear_models(ridge_fits(t, ("x1", "x2"), (1.0,)), 2)
    return M.permutation_importance(frame(t), fits, ("x1", "x2"), "y", "fold", "id", IMPORTANCE, 83)
