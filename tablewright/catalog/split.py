"""Target, split and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import registered, table
from tablewright.catalog.eda import hash_sql
from tablewright.operators import split as S

ORDER_HASH = hash_sql(["o_orderkey"], 42)


@registered(
    "target_label_encoding",
    """select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as double) as label from orders""",
)
def labels(spark, folder):
    d = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return S.encode_labels(d, "o_orderpriority").select("o_orderkey", "label")


@registered(
    "target_label_encoding_keeps_null",
    """with t as (select o_orderkey, coalesce(case when o_orderkey % 5 > 0 then o_orderstatus end, 'nan') as s from orders)
       select o_orderkey, cast((select count(distinct u.s) from t u where u.s < t.s) as double) as label from t""",
)
def labels_null(spark, folder):
    d = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("s")
    )
    return S.encode_labels(d, "s", keep_null=True).select("o_orderkey", "label")


@registered(
    "target_numeric",
    """select event_id, label from (select event_id, try_cast(case when event_id % 4 = 0 then event_type
         else cast(value as varchar) end as double) as label from events) where label is not null""",
)
def numeric(spark, folder):
    d = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 == 0, F.col("event_type"))
        .otherwise(F.col("value").cast("string"))
        .alias("t"),
    )
    return S.numeric_target(d, "t").select("event_id", "label")


@registered(
    "split_random",
    f"""select o_orderkey, row_number() over (order by {ORDER_HASH}, o_orderkey)
          <= ceil((select count(*) from orders) * 0.2::double) as is_test from orders""",
)
def split_random(spark, folder):
    d = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return S.assign_split(d, key=["o_orderkey"]).select("o_orderkey", "is_test")


@registered(
    "split_stratified",
    f"""with s as (select o_orderstatus as c, count(*) as n from orders group by 1),
        t as (select sum(n) as total, cast(ceil(sum(n) * 0.2::double) as bigint) as wanted from s),
        q as (select c, wanted * n // total as base, wanted * n % total as rest, wanted from s, t),
        r as (select c, base + case when row_number() over (order by rest desc, c)
                <= wanted - sum(base) over () then 1 else 0 end as quota from q)
        select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus
            order by {ORDER_HASH}, o_orderkey) <= quota as is_test
        from orders join r on c = o_orderstatus""",
)
def split_stratified(spark, folder):
    d = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return S.assign_split(d, label="o_orderstatus", key=["o_orderkey"])


@registered(
    "split_without_key_sizes",
    """with s as (select p_type, count(*) as n from part group by 1),
        t as (select cast(sum(n) as bigint) as total, cast(ceil(sum(n) * 0.2::double) as bigint) as wanted from s),
        q as (select p_type, n, wanted * n // total as base, wanted * n % total as rest, wanted from s, t)
       select p_type, n, cast(base + case when row_number() over (order by rest desc, p_type)
           <= wanted - sum(base) over () then 1 else 0 end as bigint) as n_test from q""",
)
def split_copies(spark, folder):
    # no key: equal rows (same type and brand) are numbered, then split exactly
    d = table(spark, folder, "part").select("p_type", "p_brand")
    marked = S.assign_split(d, label="p_type")
    return marked.groupBy("p_type").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("n_test")
    )


@registered(
    "folds_stratified",
    f"""select o_orderkey, cast((row_number() over (partition by o_orderstatus
          order by {ORDER_HASH}, o_orderkey) - 1) % 5 as int) as fold from orders""",
)
def folds_stratified(spark, folder):
    d = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return S.assign_folds(d, folds=5, label="o_orderstatus", key=["o_orderkey"]).drop("o_orderstatus")


@registered(
    "folds_regression",
    f"""select o_orderkey, cast(floor((row_number() over (order by {ORDER_HASH}, o_orderkey) - 1) * 3
          / (select count(*) from orders)::double) as int) as fold from orders""",
)
def folds_plain(spark, folder):
    d = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return S.assign_folds(d, folds=3, key=["o_orderkey"]).drop("o_totalprice")


@registered(
    "folds_effective_count",
    """select cast(greatest(2, least(10, (select min(n) from (select count(*) as n from part group by p_name)))) as int) as folds""",
)
def folds_effective(spark, folder):
    d = table(spark, folder, "part")
    return spark.createDataFrame([(S.effective_folds(d, 10, "p_name"),)], "folds int")


@registered(
    "feature_schema_capture",
    " union all ".join(
        f"select '{c}' as name, '{t}' as dtype, count({c}) as n_present from customer"
        for c, t in [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string")]
    ),
)
def schema_capture(spark, folder):
    """The captured schema, and how many rows can fill each of its columns."""
    customer = table(spark, folder, "customer")
    schema = S.feature_schema(customer, "c_acctbal")
    return customer.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c["name"]).alias("name"), F.lit(c["dtype"]).alias("dtype"),
                    F.count(c["name"]).alias("n_present"),
                )
                for c in schema
            ]
        ).alias("rows")
    ).select(F.inline("rows"))
