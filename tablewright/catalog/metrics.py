"""Evaluation queries: predictions are derived from the tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import registered, rounded, table
from tablewright.catalog.eda import hash_sql
from tablewright.operators import metrics as M

# truth: is the line returned; score: a price-and-discount rule with ties; three-way: the flag
BINARY_SQL = """select case when l_returnflag = 'R' then 1 else 0 end as label,
    floor(l_quantity * (1 + 10 * l_discount) * 10) / 1000 as score,
    case when floor(l_quantity * (1 + 10 * l_discount) * 10) / 1000 > 0.4 then 1 else 0 end as prediction
    from lineitem"""
MULTI_SQL = """select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label,
    l_linenumber % 3 as prediction, l_quantity / 50 as s0, l_discount * 10 as s1,
    1 - l_quantity / 50 as s2 from lineitem"""
REGRESSION_SQL = """select l_orderkey, l_linenumber, l_extendedprice as label,
    l_quantity * (900 + l_partkey % 1000) as prediction from lineitem"""


def binary(spark, folder):
    score = F.floor(F.col("l_quantity") * (1 + 10 * F.col("l_discount")) * 10) / 1000
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        score.alias("score"),
        F.when(score > 0.4, 1).otherwise(0).alias("prediction"),
    )


def multi(spark, folder):
    q, d = F.col("l_quantity") / 50, F.col("l_discount") * 10
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 0)
        .when(F.col("l_returnflag") == "N", 1)
        .otherwise(2)
        .alias("label"),
        (F.col("l_linenumber") % 3).alias("prediction"),
        F.array(q, d, 1 - q).alias("scores"),
    )


def regression(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * (900 + F.col("l_partkey") % 1000)).alias("prediction"),
    )


CLASS_METRICS_SQL = """
    with d as ({source}), c as (select label as cls from d union select prediction from d),
    s as (select cls, (select count(*) from d where label = cls) as support,
            (select count(*) from d where prediction = cls) as predicted,
            (select count(*) from d where prediction = cls and label = cls) as hits from c),
    f as (select support, case when predicted > 0 then hits / predicted::double else 0 end as p,
            case when support > 0 then hits / support::double else 0 end as r,
            2.0 * hits / (support + predicted) as f1 from s)
    select round((select avg((label = prediction)::int) from d), 6) as accuracy,
      round(sum(p * support) / sum(support), 6) as precision_weighted,
      round(sum(r * support) / sum(support), 6) as recall_weighted,
      round(sum(f1 * support) / sum(support), 6) as f1_weighted, round(avg(f1), 6) as f1_macro
    from f"""


@registered("metrics_classification_binary", CLASS_METRICS_SQL.format(source=BINARY_SQL))
def classification_binary(spark, folder):
    return rounded(M.classification_metrics(binary(spark, folder)))


@registered("metrics_classification_multiclass", CLASS_METRICS_SQL.format(source=MULTI_SQL))
def classification_multi(spark, folder):
    return rounded(M.classification_metrics(multi(spark, folder)))


@registered(
    "metrics_per_class",
    f"""with d as ({MULTI_SQL}), c as (select distinct label as cls from d)
        select cls as class, (select count(*) from d where label = cls) as support,
          round((select avg((label = cls)::int) from d where prediction = cls), 6) as precision,
          round((select avg((prediction = cls)::int) from d where label = cls), 6) as recall,
          round(2.0 * (select count(*) from d where prediction = cls and label = cls) /
            ((select count(*) from d where label = cls) + (select count(*) from d where prediction = cls)), 6) as f1
        from c""",
)
def per_class(spark, folder):
    return rounded(M.per_class(multi(spark, folder)))


def auc_sql(positive: str, score: str, source: str) -> str:
    return f"""(select (sum(r) filter (where y) - count(*) filter (where y) * (count(*) filter (where y) + 1) / 2.0)
        / (count(*) filter (where y) * count(*) filter (where not y)::double)
      from (select y, (min(n) over (partition by s) + max(n) over (partition by s)) / 2.0 as r
            from (select {positive} as y, {score} as s, row_number() over (order by {score}) as n from ({source}))))"""


@registered(
    "metrics_roc_auc_binary",
    f"select round({auc_sql('label = 1', 'score', BINARY_SQL)}, 6) as roc_auc",
)
def auc_binary(spark, folder):
    return rounded(M.roc_auc(binary(spark, folder)))


MISSING_SQL = f"select label, coalesce(case when score <> 0.25 and label + floor(score * 100) % 7 > 0 then score end, -1) as score from ({BINARY_SQL})"


@registered(
    "metrics_roc_auc_missing_scores",
    f"select round({auc_sql('label = 1', 'score', MISSING_SQL)}, 6) as roc_auc",
)
def auc_missing(spark, folder):
    """A missing score is the lowest of all."""
    known = (F.col("score") != 0.25) & (F.col("label") + F.floor(F.col("score") * 100) % 7 > 0)
    return rounded(M.roc_auc(binary(spark, folder).withColumn("score", F.when(known, F.col("score")))))


@registered(
    "metrics_roc_auc_multiclass",
    "select round(("
    + " + ".join(
        f"{auc_sql(f'label = {c}', f's{c}', MULTI_SQL)} * (select count(*) from ({MULTI_SQL}) where label = {c})"
        for c in range(3)
    )
    + ") / (select count(*) from lineitem), 6) as roc_auc",
)
def auc_multi(spark, folder):
    return rounded(M.roc_auc_multiclass(multi(spark, folder)))


@registered(
    "metrics_confusion_matrix",
    f"""with d as ({MULTI_SQL}) select cast(a.c as int) as label, cast(b.c as int) as prediction,
          (select count(*) from d where label = a.c and prediction = b.c) as n
        from (select unnest(range(4)) as c) a, (select unnest(range(4)) as c) b""",
)
def confusion(spark, folder):
    return M.confusion_matrix(multi(spark, folder), 4)


@registered(
    "metrics_roc_curve",
    f"""with d as (select score, count(*) filter (where label = 1) as pos, count(*) filter (where label <> 1) as neg
                   from ({BINARY_SQL}) group by score)
        select round(score, 6) as threshold, round(sum(neg) over w / (select sum(neg) from d), 6) as fpr,
          round(sum(pos) over w / (select sum(pos) from d), 6) as tpr
        from d window w as (order by score desc)
        union all select null, 0.0, 0.0""",
)
def roc_curve(spark, folder):
    return rounded(M.roc_curve(binary(spark, folder)))


def _regression_sql(source: str) -> str:
    return f"""select round(1 - avg((label - prediction) ** 2) / var_pop(label), 6) as r2,
        round(avg(abs(label - prediction)), 4) as mae, round(avg((label - prediction) ** 2), 2) as mse,
        round(sqrt(avg((label - prediction) ** 2)), 4) as rmse,
        round(1 - var_pop(label - prediction) / var_pop(label), 6) as explained_variance,
        case when count(*) filter (where label = 0) = 0 then round(avg(abs((label - prediction) / label)), 6) end as mape
        from ({source})"""


def _rounded_metrics(df):
    digits = {"mae": 4, "mse": 2, "rmse": 4}
    return df.select(*[F.round(c, digits.get(c, 6)).alias(c) for c in df.columns])


@registered("metrics_regression", _regression_sql(REGRESSION_SQL))
def regression_scores(spark, folder):
    return _rounded_metrics(M.regression_metrics(regression(spark, folder)))


@registered(
    "metrics_regression_zero_targets",
    """select round(1 - avg((label - prediction) ** 2) / var_pop(label), 6) as r2,
        round(avg(abs(label - prediction)), 4) as mae, round(avg((label - prediction) ** 2), 2) as mse,
        round(sqrt(avg((label - prediction) ** 2)), 4) as rmse,
        round(1 - var_pop(label - prediction) / var_pop(label), 6) as explained_variance,
        cast(null as double) as mape
        from (select l_discount as label, l_tax as prediction from lineitem)""",
)
def regression_zeros(spark, folder):
    d = table(spark, folder, "lineitem").select(
        F.col("l_discount").alias("label"), F.col("l_tax").alias("prediction")
    )
    return _rounded_metrics(M.regression_metrics(d))


@registered(
    "metrics_residuals",
    f"select l_orderkey, l_linenumber, round(prediction, 4) as prediction, round(label - prediction, 4) as residual from ({REGRESSION_SQL})",
)
def residuals(spark, folder):
    d = M.residuals(regression(spark, folder))
    return rounded(d.select("l_orderkey", "l_linenumber", "prediction", "residual"), 4)


@registered(
    "metrics_predicted_vs_actual_sample",
    f"""select o_orderkey, round(o_totalprice, 4) as actual, cast(o_custkey * 100 as double) as predicted
        from orders order by {hash_sql(['o_orderkey'], 42)}, o_orderkey limit 2000""",
)
def predicted_vs_actual(spark, folder):
    d = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("label"), (F.col("o_custkey") * 100).alias("prediction")
    )
    return rounded(M.predicted_vs_actual(d, key=["o_orderkey"], points=2000), 4)


@registered(
    "metrics_predicted_vs_actual",
    "select o_orderkey, round(o_totalprice, 4) as actual, cast(o_custkey * 100 as double) as predicted from orders",
)
def predicted_vs_actual_all(spark, folder):
    """Every point of the chart."""
    d = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("label"), (F.col("o_custkey") * 100).alias("prediction")
    )
    return rounded(M.predicted_vs_actual(d, key=["o_orderkey"]), 4)


@registered(
    "metrics_ideal_line",
    f"""select round(least(min(label), min(prediction)), 4) as low,
          round(greatest(max(label), max(prediction)), 4) as high from ({REGRESSION_SQL})""",
)
def ideal_line(spark, folder):
    return rounded(M.ideal_line(regression(spark, folder)), 4)


# runs: each customer's orders are runs of an experiment; the priority is the algorithm
RUNS_SQL = """select o_custkey as experiment_id, o_orderkey as position, o_orderpriority as algorithm,
    case o_orderstatus when 'F' then 'failed' else 'completed' end as status,
    case when o_orderpriority like '1%' then 'rmse' when o_orderpriority like '2%' then 'mae' else 'accuracy' end as metric,
    case when o_orderkey % 7 = 0 then null else floor(o_totalprice / 50000) end as value from orders"""


def runs(spark, folder):
    d = table(spark, folder, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    return d.select(
        F.col("o_custkey").alias("experiment_id"),
        F.col("o_orderkey").alias("position"),
        F.col("o_orderpriority").alias("algorithm"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        F.when(first == "1", "rmse").when(first == "2", "mae").otherwise("accuracy").alias("metric"),
        F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") / 50000).cast("double")).alias("value"),
    ).withColumn("primary_score", M.ranking_score(F.col("metric"), F.col("value")))


SCORED_RUNS_SQL = f"""select experiment_id, position, algorithm, status,
    case when metric in ('mae', 'mse', 'rmse', 'mape') then -value else value end as primary_score from ({RUNS_SQL})"""


@registered("metrics_ranking_score", SCORED_RUNS_SQL)
def ranking(spark, folder):
    return runs(spark, folder).drop("metric", "value")


@registered(
    "runs_best_per_experiment",
    f"""select experiment_id, position, algorithm, primary_score from (
          select *, row_number() over (partition by experiment_id order by primary_score desc, position) as r
          from ({SCORED_RUNS_SQL}) where status = 'completed' and primary_score is not null) where r = 1""",
)
def best_runs(spark, folder):
    best = M.best_runs(runs(spark, folder))
    return best.select("experiment_id", "position", "algorithm", "primary_score")


@registered("runs_leaderboard", SCORED_RUNS_SQL)
def leaderboard(spark, folder):
    return M.leaderboard(runs(spark, folder).drop("metric", "value"))
