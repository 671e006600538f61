"""Model queries whose values SQL can work out: leaf means, first splits, closed forms of ridge
regression with what follows from them, and losses over a grid of weights."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablewright.catalog.base import registered, rounded, table
from tablewright.catalog.eda import hash_sql
from tablewright.catalog.models import quality
from tablewright.ml import algorithms as A
from tablewright.ml.insensitive import fit_insensitive
from tablewright.operators import explain as X
from tablewright.operators.features import FeatureConfig, fit_features
from tablewright.plans import automl, scoring
from tablewright.session import shared_folder

# ---- trees: a full tree gives the mean of the rows that are alike in all features ----

LEAVES_SQL = """select l_quantity, l_discount, l_tax, round(avg(sqrt(l_extendedprice)), 4) as prediction
    from lineitem group by l_quantity, l_discount, l_tax"""


def _leaves(spark, folder, key, params):
    lines = table(spark, folder, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", F.sqrt("l_extendedprice").alias("label")
    )
    fitted = fit_features(lines, FeatureConfig(scaling="none"), "label", "regression")
    frame = fitted.transform(lines)
    model = A.get_algorithm(key).fit(frame, A.Context("regression", lines.count()), params)
    asked = frame.select("l_quantity", "l_discount", "l_tax", "features").dropDuplicates(["l_quantity", "l_discount", "l_tax"])
    return rounded(model.transform(asked).select("l_quantity", "l_discount", "l_tax", "prediction"), 4)


@registered("model_decision_tree_leaves", LEAVES_SQL)
def tree_leaves(spark, folder):
    return _leaves(spark, folder, "decision_tree", {})


@registered("model_extra_trees_leaves", LEAVES_SQL)
def extra_leaves(spark, folder):
    return _leaves(spark, folder, "extra_trees", {"n_estimators": 10, "max_features": "sqrt"})


@registered(
    "model_decision_tree_first_split",
    """with d as (select l_quantity as q, l_discount as t, sqrt(l_extendedprice) as y from lineitem),
        x as (select 'numeric__l_quantity' as f, q as v, y from d union all select 'numeric__l_discount', t, y from d),
        g as (select f, v, count(*) as n, sum(y) as s from x group by all),
        c as (select f, v, lead(v) over w as following, sum(n) over w as nl, sum(s) over w as sl, sum(n) over (partition by f) as n,
                sum(s) over (partition by f) as s from g window w as (partition by f order by v)),
        b as (select *, sl * sl / nl + (s - sl) ** 2 / (n - nl) as gain from c where following is not null)
       select f as feature, round((v + following) / 2, 4) as cut, round(sl / nl, 3) as left_mean, round((s - sl) / (n - nl), 3) as right_mean
       from b order by gain desc limit 1""",
)
def first_split(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_discount", F.sqrt("l_extendedprice").alias("label"))
    fitted = fit_features(lines, FeatureConfig(scaling="none"), "label", "regression")
    model = A.get_algorithm("decision_tree").fit(
        fitted.transform(lines), A.Context("regression", lines.count()), {"max_depth": 1}
    )
    root = model.trees[0]
    row = (fitted.names[root.feature[0]], float(root.cut[0]), float(root.cut[1]), float(root.cut[2]))
    df = spark.createDataFrame([row], "feature string, cut double, left_mean double, right_mean double")
    return df.select("feature", F.round("cut", 4).alias("cut"), F.round("left_mean", 3).alias("left_mean"), F.round("right_mean", 3).alias("right_mean"))


@registered(
    "model_decision_tree_shares",
    """select lang, source, round(avg(quality), 6) as share from documents join labels using (doc_id) group by lang, source""",
)
def tree_shares(spark, folder):
    d = quality(spark, folder).select("lang", "source", F.col("quality").cast("double").alias("label"))
    frame = fit_features(d, FeatureConfig(), "label", "classification").transform(d)
    model = A.get_algorithm("decision_tree").fit(frame, A.Context("classification", d.count(), 2), {})
    asked = model.transform(frame.dropDuplicates(["lang", "source"]))
    return rounded(asked.select("lang", "source", F.get(vector_to_array("probability"), F.lit(1)).alias("share")))


# ---- fits whose mean prediction is the mean of the labels ----


@registered(
    "model_logistic_mean_probability",
    "select count(*) as n, round(avg(quality), 3) as mean from documents join labels using (doc_id)",
)
def logistic_mean(spark, folder):
    """The intercept is not penalised, so the fitted probabilities add up to the number of hits."""
    d = quality(spark, folder).select("lang", "source", "n_chars", F.col("quality").cast("double").alias("label"))
    frame = fit_features(d, FeatureConfig(), "label", "classification").transform(d)
    model = A.get_algorithm("logistic_regression").fit(frame, A.Context("classification", d.count(), 2), {})
    share = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(frame).agg(F.count("*").alias("n"), F.round(F.avg(share), 3).alias("mean"))


@registered(
    "model_boosting_mean_prediction",
    "select count(*) as n, round(avg(p_retailprice / 7), 4) as mean from part",
)
def boosting_mean(spark, folder):
    """Every leaf of every stage is a mean of residuals, so the predictions add up to the labels."""
    d = table(spark, folder, "part").select("p_size", "p_brand", (F.col("p_retailprice") / 7).alias("label"))
    frame = fit_features(d, FeatureConfig(), "label", "regression").transform(d)
    model = A.get_algorithm("gradient_boosting").fit(frame, A.Context("regression", d.count()), {"n_estimators": 10})
    return model.transform(frame).agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 4).alias("mean"))


BAYES_SQL = " union all ".join(
    f"""(with s as (select p_type as t, ln(count(*) / (select count(*) from part)::double) as prior, avg(p_size) as ma, var_pop(p_size) as va,
           avg(p_retailprice) as mb, var_pop(p_retailprice) as vb,
           (select greatest(var_pop(p_size), var_pop(p_retailprice)) from part) * {smoothing} as eps from part group by 1),
        g as (select p_partkey, t, prior - 0.5 * (ln(2 * pi() * (va + eps)) + (p_size - ma) ** 2 / (va + eps)
             + ln(2 * pi() * (vb + eps)) + (p_retailprice - mb) ** 2 / (vb + eps)) as score from part, s)
       select {smoothing}::double as smoothing, p_partkey, round(exp(max(score)) / sum(exp(score)), 5) as share from g group by p_partkey)"""
    for smoothing in ("1e-9", "0.05")
)


@registered("model_gaussian_bayes_smoothing", BAYES_SQL)
def bayes_smoothing(spark, folder):
    from tablewright.operators.split import prepare_target

    d, names = prepare_target(table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_type"), "p_type", "classification")
    frame = fit_features(d.drop("p_type", "p_partkey"), FeatureConfig(scaling="none"), "label").transform(d)
    context, found = A.Context("classification", frame.count(), len(names)), None
    for smoothing in (1e-9, 0.05):
        model = A.get_algorithm("naive_bayes").fit(frame, context, {"var_smoothing": smoothing})
        share = F.array_max(vector_to_array("probability"))
        scored = model.transform(frame).select(F.lit(smoothing).alias("smoothing"), "p_partkey", F.round(share, 5).alias("share"))
        found = scored if found is None else found.unionByName(scored)
    return found


# ---- support vector regression: no weights of a grid have a lower loss ----

GRID = [(w / 4, b) for w in range(-2, 7) for b in (40, 44, 48, 52, 56, 60)]


@registered(
    "model_svm_regression_epsilon",
    """with d as (select p_size / 10.0::double as x, p_size * 0.05 + p_retailprice / 20 + p_partkey % 7 as y from part),
        g as (select w / 4.0::double as w, b::double as b from (select unnest(range(-2, 7)) as w), (select unnest([40, 44, 48, 52, 56, 60]) as b))
       select w, b, round((w * w / 2 + sum(greatest(abs(y - w * x - b) - 0.1, 0))) / count(*), 5) as loss, true as solution_not_above
       from d, g group by w, b""",
)
def svm_grid(spark, folder):
    d = table(spark, folder, "part").select(
        (F.col("p_size") / 10.0).alias("x"),
        (F.col("p_size") * 0.05 + F.col("p_retailprice") / 20 + F.col("p_partkey") % 7).alias("label"),
    )
    model = fit_insensitive(d.withColumn("features", array_to_vector(F.array("x"))), None, 1.0, 0.1)
    scores = model.stages[0]
    w, b = scores.getOrDefault("weights")[0], scores.getOrDefault("intercept")

    def loss(w, b):
        total = F.sum(F.greatest(F.abs(F.col("label") - w * F.col("x") - b) - 0.1, F.lit(0.0)))
        return (w * w / 2 + total) / F.count("*")

    own = d.agg(loss(F.lit(w), F.lit(b))).first()[0]
    grid = F.explode(F.array(*[F.struct(F.lit(float(u)).alias("w"), F.lit(float(v)).alias("b")) for u, v in GRID])).alias("g")
    spread = d.select("x", "label", grid).select("x", "label", "g.w", "g.b")
    found = spread.groupBy("w", "b").agg(loss(F.col("w"), F.col("b")).alias("loss"))
    return found.select("w", "b", F.round("loss", 5).alias("loss"), (F.lit(own) <= F.col("loss") * (1 + 1e-3)).alias("solution_not_above"))


# ---- an experiment with ridge regression on two features, in closed form ----

TARGET = "p_size * 2 + p_retailprice / 50 + p_partkey % 17"
RIDGE = f"""with d as (select p_partkey, p_size::double as a, p_retailprice::double as b, ({TARGET})::double as y from part),
    r as (select *, row_number() over (order by {hash_sql(["p_partkey"], 42)}, p_partkey) <= ceil((select count(*) from d) * 0.2::double) as is_test from d),
    t as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(y) as my, corr(a, b) as c,
            covar_pop(a, y) / stddev_pop(a) as ya, covar_pop(b, y) / stddev_pop(b) as yb, 1 + 1.0 / count(*) as e from r where not is_test),
    w as (select *, (e * ya - c * yb) / (e * e - c * c) as wa, (e * yb - c * ya) / (e * e - c * c) as wb from t),
    p as (select p_partkey, y, is_test, a, b, my + wa * (a - ma) / sa + wb * (b - mb) / sb as prediction from r, w)"""


def _parts(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"),
                                               F.expr(TARGET).cast("double").alias("y"))


def _ridge(spark, folder):
    return automl.run_experiment(
        _parts(spark, folder), "y", "regression", algorithms=["logistic_regression"], metric="r2", key=["p_partkey"]
    )


@registered(
    "automl_experiment_metrics",
    RIDGE
    + """ select 'r2' as metric, round(1 - sum((y - prediction) ** 2) / sum((y - m) ** 2), 6) as value from p, (select avg(y) as m from p where is_test) where is_test
        union all select 'rmse', round(sqrt(avg((y - prediction) ** 2)), 6) from p where is_test
        union all select 'mse', round(avg((y - prediction) ** 2), 6) from p where is_test
        union all select 'mae', round(avg(abs(y - prediction)), 6) from p where is_test""",
)
def experiment_metrics(spark, folder):
    """Split, features, fit and hold-out metrics of a run, as recorded."""
    runs = automl.run_metrics_long(_ridge(spark, folder).runs)
    return rounded(runs.filter(F.col("metric").isin("r2", "rmse", "mse", "mae")).select("metric", "value"))


@registered(
    "automl_run_charts",
    RIDGE + " select round(y, 5) as actual, round(prediction, 5) as predicted, round(y - prediction, 5) as residual from p where is_test",
)
def run_charts(spark, folder):
    """The chart data that a run stores: all hold-out rows with their residuals."""
    result = automl.run_experiment(
        _parts(spark, folder), "y", "regression", algorithms=["logistic_regression"], metric="r2", key=["p_partkey"],
        artifacts=f"{shared_folder(spark)}/artifacts",
    )
    return rounded(automl.load_charts(spark, result.runs.first()["artifact"])["residuals"], 5)


@registered("scoring_predictions", RIDGE + " select p_partkey, round(prediction, 5) as prediction from p")
def predictions(spark, folder):
    """All rows scored by the fitted run."""
    run = _ridge(spark, folder).best
    return rounded(scoring.predict(run, _parts(spark, folder).drop("y"), keep=["p_partkey"]).select("p_partkey", "prediction"), 5)


@registered(
    "explain_dependence_linear",
    RIDGE
    + """, v as (select distinct unnest(quantile_cont(a, [0, 0.25, 0.5, 0.75, 1])) as value from p where is_test)
        select value, cast(0 as int) as class, round(avg(my + wa * (value - ma) / sa + wb * (b - mb) / sb), 5) as mean_output
        from v, w, (select b from p where is_test) group by value""",
)
def dependence_linear(spark, folder):
    result = _ridge(spark, folder)
    return rounded(X.partial_dependence(result.best, result.test, "a", points=5), 5)


def _donors(n: int) -> str:
    """Test rows, ``n`` times, each with the features of its donor."""
    h = hash_sql(["p_partkey", "g"], 42)
    return f""", k as (select *, {h} as h from (select * from p where is_test), (select unnest(range(1, {n + 1})) as g)),
        l as (select *, h % ((select count(*) from k) // 1000 + 1) as bucket from k),
        z as (select *, coalesce(lead(a) over o, first_value(a) over o) as za, coalesce(lead(b) over o, first_value(b) over o) as zb
              from l window o as (partition by g, bucket order by h, p_partkey))"""


@registered(
    "explain_shapley_linear",
    RIDGE
    + _donors(10)
    + """, phi as (select p_partkey, avg(a - za) as da, avg(b - zb) as db from z group by p_partkey)
        select 'numeric__a' as feature, round(avg(abs(wa * da / sa)), 6) as importance from phi, w
        union all select 'numeric__b', round(avg(abs(wb * db / sb)), 6) from phi, w""",
)
def shapley_linear(spark, folder):
    """With a linear model a feature's value is its weight times the difference from the donor."""
    result = _ridge(spark, folder)
    return rounded(X.shapley_importance(result.best, result.test, key=["p_partkey"]))


@registered(
    "explain_permutation_linear",
    RIDGE
    + _donors(5)
    + """, m as (select avg(y) as my, sum((y - (select avg(y) from p where is_test)) ** 2) as total, sum((y - prediction) ** 2) as off from p where is_test),
        x as (select g, 'a' as feature, sum((y - (w.my + wa * (za - ma) / sa + wb * (b - mb) / sb)) ** 2) as off from z, w group by g
              union all select g, 'b', sum((y - (w.my + wa * (a - ma) / sa + wb * (zb - mb) / sb)) ** 2) from z, w group by g)
        select feature, round(avg((x.off - m.off) / total), 5) as importance, round(stddev_pop((x.off - m.off) / total), 5) as std
        from x, m group by feature""",
)
def permutation_linear(spark, folder):
    result = _ridge(spark, folder)
    return rounded(X.permutation_importance(result.best, result.test, key=["p_partkey"]), 5)


# ---- single tables of bundles ----


@registered(
    "features_preview_values",
    """select p_partkey, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 5) as numeric__p_size,
          round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 5) as numeric__p_retailprice from part""",
)
def preview_values(spark, folder):
    """Scaled features of all rows by name, as a preview shows them."""
    d = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    fitted = fit_features(d.drop("p_partkey"), FeatureConfig())
    long = fitted.transform_long(d, ["p_partkey"])
    return long.groupBy("p_partkey").pivot("feature", fitted.names).agg(F.round(F.first("value"), 5))
