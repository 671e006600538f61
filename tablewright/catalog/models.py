"""Model queries: training, scoring and explanation on the given tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.catalog.base import registered, rounded, table
from tablewright.ml import algorithms as A
from tablewright.ml.knn import NearestNeighbours
from tablewright.operators import explain as X
from tablewright.operators import metrics as M
from tablewright.operators.features import FeatureConfig, Imputation
from tablewright.operators.split import assign_split
from tablewright.plans import automl, scoring


def quality(spark, folder):
    """Labelled documents: is a document of good quality?"""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(labels, "doc_id")


def prices(spark, folder):
    """Lines with their price, driven by quantity and part."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "l_tax", "l_returnflag", "l_extendedprice",
    )


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
    )


def _run(spark, folder, algorithm="logistic_regression"):
    result = automl.run_experiment(
        quality(spark, folder), "quality", "classification", algorithms=[algorithm],
        metric="roc_auc", key=["doc_id"],
    )
    return result.fitted[algorithm], result.test


def _knn_sql(k: int, vote: str) -> str:
    """Every row's k nearest other-half rows: odd ids ask, even ids answer."""
    return f"""with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 2 = 1),
        t as (select vec_id as t_id, label, embedding::double[] as e from embeddings where vec_id % 2 = 0),
        d as (select q.vec_id, label, list_distance(q.e, t.e) as d,
                row_number() over (partition by q.vec_id order by list_distance(q.e, t.e), label) as r from q, t)
        select vec_id, {vote} from d where r <= {k} group by vec_id"""


def _halves(spark, folder):
    v = vectors(spark, folder)
    return v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1")


@registered(
    "model_knn_classes",
    f"""with n as ({_knn_sql(5, 'list(label) as labels')}),
        v as (select vec_id, c, len(list_filter(labels, lambda x: x = c)) as votes
              from n, (select unnest(range(10)) as c)),
        b as (select vec_id, c, votes, row_number() over (partition by vec_id order by votes desc, c) as r from v)
        select vec_id, cast(c as double) as prediction, round(votes / 5.0, 6) as share from b where r = 1""",
)
def knn_classes(spark, folder):
    train, ask = _halves(spark, folder)
    scored = NearestNeighbours.fit(train, k=5, n_classes=10).transform(ask)
    from pyspark.ml.functions import vector_to_array

    return rounded(
        scored.select("vec_id", "prediction", F.array_max(vector_to_array("probability")).alias("share"))
    )


@registered(
    "model_knn_regression_by_distance",
    _knn_sql(7, "round(sum(label / d) / sum(1 / d), 6) as prediction"),
)
def knn_regression(spark, folder):
    train, ask = _halves(spark, folder)
    scored = NearestNeighbours.fit(train, k=7, weighting="distance").transform(ask)
    return rounded(scored.select("vec_id", "prediction"))


@registered(
    "model_knn_partitioned_join",
    _knn_sql(7, "round(sum(label / d) / sum(1 / d), 6) as prediction"),
)
def knn_cells(spark, folder):
    train, ask = _halves(spark, folder)
    rows = NearestNeighbours.fit(train, k=7, weighting="distance").transform(ask.repartition(16, "vec_id"))
    return rounded(rows.select("vec_id", "prediction"))


@registered(
    "model_linear_regression_coefficients",
    """select 'numeric__l_quantity' as feature, round(covar_pop(y, z) / (1 + 1.0 / count(*)), 3) as coefficient
       from (select l_extendedprice as y, (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as z
             from lineitem)""",
)
def ridge(spark, folder):
    # one standardised feature: the ridge weight is cov / (1 + alpha / n)
    from tablewright.operators.features import fit_features

    d = table(spark, folder, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    fitted = fit_features(d, FeatureConfig(), "label")
    frame = fitted.transform(d)
    model = A.get_algorithm("logistic_regression").fit(frame, A.Context("regression", frame.count()), {"alpha": 1.0})
    rows = list(zip(fitted.names, [float(c) for c in model.coefficients], strict=True))
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double"), 3)


@registered(
    "model_gaussian_bayes",
    """with s as (select p_type as t, ln(count(*) / (select count(*) from part)::double) as prior, avg(p_size) as ma, var_pop(p_size) as va,
           avg(p_retailprice) as mb, var_pop(p_retailprice) as vb,
           (select greatest(var_pop(p_size), var_pop(p_retailprice)) from part) * 1e-9 as eps from part group by 1),
        g as (select p_partkey, t, prior - 0.5 * (ln(2 * pi() * (va + eps)) + (p_size - ma) ** 2 / (va + eps)
             + ln(2 * pi() * (vb + eps)) + (p_retailprice - mb) ** 2 / (vb + eps)) as score from part, s)
       select p_partkey, arg_max(t, score) as prediction, round(exp(max(score)) / sum(exp(score)), 5) as share from g group by 1""",
)
def bayes(spark, folder):
    from pyspark.ml.functions import vector_to_array

    from tablewright.operators.features import fit_features
    from tablewright.operators.split import prepare_target

    d, names = prepare_target(
        table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_type"),
        "p_type", "classification",
    )
    inputs = d.drop("p_type", "p_partkey")
    fitted = fit_features(inputs, FeatureConfig(scaling="none"), "label")
    frame = fitted.transform(d)
    model = A.get_algorithm("naive_bayes").fit(frame, A.Context("classification", frame.count(), len(names)), {})
    scored = model.transform(frame)
    from tablewright.functions.scalars import decode_label

    return rounded(
        scored.select(
            "p_partkey", decode_label(F.col("prediction"), names).alias("prediction"),
            F.array_max(vector_to_array("probability")).alias("share"),
        ),
        5,
    )


def _algorithm_query(key: str, params: dict, task: str) -> None:
    @registered(f"model_{key}_{task}")
    def query(spark, folder):
        """Fit on four fifths, measure on the rest."""
        if task == "classification":
            data, target, keys = quality(spark, folder), "quality", ["doc_id"]
        else:
            data, target = prices(spark, folder), "l_extendedprice"
            data = data.groupBy("l_orderkey").agg(
                F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
                F.max("l_returnflag").alias("flag"), F.avg(target).alias(target),
            )
            data = data.persist()  # what follows reads the orders many times, the lines once
            keys = ["l_orderkey"]
        controls = automl.TrainingControls()
        prepared = automl.prepare_data(data, target, task, FeatureConfig(), controls, keys)
        from tablewright.operators.features import fit_features

        train = prepared.train.persist()
        fitted = fit_features(train.drop(*keys), prepared.config, "label", task)
        n = train.count()
        inside = automl.vectors(fitted, train, n).persist()
        outside = automl.vectors(fitted, prepared.test, n).persist()
        spec = A.get_algorithm(key)
        classes = len(prepared.names or [])
        model = spec.fit(inside, A.Context(task, n, classes), params)
        found = M.all_metrics(automl.scored_frame(model, outside, bool(classes)), classes)
        for frame in (data, train, inside, outside):
            frame.unpersist()
        rows = [(key, name, value) for name, value in found.items()]
        return spark.createDataFrame(rows, "algorithm string, metric string, value double")


for _task in ("classification", "regression"):
    for _key in A.available_keys(_task):
        _algorithm_query(_key, {}, _task)


@registered("automl_experiment_runs")
def experiment(spark, folder):
    """All algorithms on the quality labels; one row per run."""
    result = automl.run_experiment(quality(spark, folder), "quality", "classification", key=["doc_id"])
    return automl.run_metrics_long(result.runs)


@registered("automl_tuning_trials")
def tuning(spark, folder):
    """A random search over the penalty, three folds."""
    controls = automl.TrainingControls(optimize=True)
    data = automl.prepare_data(
        quality(spark, folder), "quality", "classification", FeatureConfig(), controls, ["doc_id"]
    )
    _, trials = automl.tune(
        A.get_algorithm("logistic_regression"), data.train, "classification", data.config,
        "roc_auc", controls, len(data.names), ["doc_id"],
    )
    return trials


@registered("automl_learning_curve")
def learning_curve(spark, folder):
    return automl.learning_curve(
        quality(spark, folder), "quality", "classification", "logistic_regression",
        metric="accuracy", key=["doc_id"],
    )


@registered("scoring_batch_probabilities")
def batch(spark, folder):
    """All documents scored by a model trained on the labelled ones."""
    run, _ = _run(spark, folder)
    return scoring.predict(run, table(spark, folder, "documents"), keep=["doc_id"]).select(
        "doc_id", "prediction", F.map_values("probabilities").alias("probabilities")
    )


@registered(
    "scoring_json_records",
    """select event_id, json_extract_string(props, '$.k') as k,
         case when event_id % 3 = 0 then ['value'] else [] end as missing,
         case when event_id % 3 > 0 then value end as value from events""",
)
def json_records(spark, folder):
    record = F.when(
        F.col("event_id") % 3 == 0, F.col("props")
    ).otherwise(
        F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("value")))
    )
    schema = [{"name": "k", "dtype": "string"}, {"name": "value", "dtype": "double"}]
    parsed = scoring.records_from_json(
        table(spark, folder, "events").select("event_id", record.alias("record")), "record", schema
    )
    typed = scoring.coerce(parsed.select("event_id", "missing", "k", "value"), schema, ["event_id", "missing"])
    return typed.select("event_id", "k", "missing", "value")


@registered(
    "explain_sample",
    """select l_orderkey from (select distinct l_orderkey from lineitem)
       order by cast('0x' || substr(md5(cast(l_orderkey as varchar) || '|42'), 1, 15) as bigint), l_orderkey limit 500""",
)
def sample(spark, folder):
    keys = table(spark, folder, "lineitem").select("l_orderkey").distinct()
    return X.explain_sample(keys, ["l_orderkey"], 500)


@registered("explain_permutation_importance")
def permutation(spark, folder):
    run, test = _run(spark, folder)
    return X.permutation_importance(run, test, key=["doc_id"])


@registered("explain_shapley_importance")
def shapley(spark, folder):
    run, test = _run(spark, folder, "decision_tree")
    return X.shapley_importance(run, test, key=["doc_id"])


@registered("explain_partial_dependence")
def dependence(spark, folder):
    run, test = _run(spark, folder)
    return X.partial_dependence(run, test, "n_chars")
