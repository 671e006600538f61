"""Feature-engineering queries, in long form ``(key, feature, value)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import registered, rounded, table
from tablewright.operators import features as X
from tablewright.operators.categories import CategoryNumbers
from tablewright.operators.features import FeatureConfig, Imputation

# part with holes: every seventh size and every fifth type are missing
PART_SQL = """(select p_partkey, case when p_partkey % 7 > 0 then p_size::double end as p_size,
    p_retailprice, case when p_partkey % 5 > 0 then p_type end as p_type from part)"""
TYPES_SQL = f"(select distinct p_type as t from {PART_SQL} where p_type is not null)"


def part(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 7 > 0, F.col("p_size").cast("double"))
        .otherwise(F.lit(float("nan")))
        .alias("p_size"),
        "p_retailprice",
        F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("p_type"),
    )


def fitted_long(spark, folder, config, columns):
    d = part(spark, folder).select("p_partkey", *columns)
    fitted = X.fit_features(d.drop("p_partkey"), config)
    return rounded(fitted.transform_long(d, ["p_partkey"]))


def _numeric_query(name: str, strategy: str, fill: str, scaling: str, scale: str) -> None:
    """Both numeric columns, imputed by SQL ``fill``, scaled by SQL ``scale`` of ``v``."""
    sql = " union all ".join(
        f"""select p_partkey, 'numeric__{c}' as feature, round({scale}, 6) as value
            from (select p_partkey, coalesce({c}, (select {fill.format(c=c)} from {PART_SQL})) as v
                  from {PART_SQL})"""
        for c in ("p_size", "p_retailprice")
    )

    @registered(name, sql)
    def query(spark, folder):
        config = FeatureConfig(
            scaling=scaling, imputation=Imputation(numeric_strategy=strategy, numeric_fill_value=-1.5)
        )
        return fitted_long(spark, folder, config, ["p_size", "p_retailprice"])


MEDIAN = "quantile_cont({c}, 0.5)"
_numeric_query("features_impute_mean", "mean", "avg({c})", "none", "v")
_numeric_query("features_impute_median", "median", MEDIAN, "none", "v")
_numeric_query(
    "features_impute_most_frequent", "most_frequent",
    "max((select v from (select {c} as v, count(*) as n from " + PART_SQL
    + " where {c} is not null group by 1) order by n desc, v limit 1))", "none", "v",
)
_numeric_query("features_impute_constant", "constant", "max(-1.5)", "none", "v")
_numeric_query(
    "features_scale_standard", "median", MEDIAN, "standard",
    "(v - avg(v) over ()) / stddev_pop(v) over ()",
)
_numeric_query(
    "features_scale_minmax", "median", MEDIAN, "minmax",
    "(v - min(v) over ()) / (max(v) over () - min(v) over ())",
)
_numeric_query(
    "features_scale_robust", "median", MEDIAN, "robust",
    "(v - quantile_cont(v, 0.5) over ()) / (quantile_cont(v, 0.75) over () - quantile_cont(v, 0.25) over ())",
)

MODE_SQL = f"""(select p_type from {PART_SQL} where p_type is not null group by 1
    order by count(*) desc, p_type limit 1)"""


@registered(
    "features_onehot",
    f"""select p_partkey, 'categorical__p_type_' || t as feature,
          case when coalesce(p_type, {MODE_SQL}) = t then 1.0 else 0.0 end as value
        from {PART_SQL}, {TYPES_SQL}""",
)
def onehot(spark, folder):
    return fitted_long(spark, folder, FeatureConfig(), ["p_type"])


@registered(
    "features_onehot_constant_fill",
    f"""select p_partkey, 'categorical__p_type_' || t as feature,
          case when coalesce(p_type, 'missing') = t then 1.0 else 0.0 end as value
        from {PART_SQL}, (select distinct coalesce(p_type, 'missing') as t from {PART_SQL})""",
)
def onehot_constant(spark, folder):
    config = FeatureConfig(imputation=Imputation(categorical_strategy="constant"))
    return fitted_long(spark, folder, config, ["p_type"])


@registered(
    "features_onehot_unknown_is_zero",
    f"""select p_partkey, 'categorical__p_brand_' || t as feature,
          case when p_brand = t then 1.0 else 0.0 end as value
        from part, (select distinct p_brand as t from part where p_partkey % 2 = 0 and p_brand <> 'Brand#7')""",
)
def onehot_unknown(spark, folder):
    d = table(spark, folder, "part").select("p_partkey", "p_brand")
    seen = d.filter((F.col("p_partkey") % 2 == 0) & (F.col("p_brand") != "Brand#7"))
    fitted = X.fit_features(seen.drop("p_partkey"), FeatureConfig())
    return fitted.transform_long(d, ["p_partkey"])


@registered(
    "features_ordinal_unknown_is_minus_one",
    """with s as (select p_brand, row_number() over (order by p_brand) - 1 as i
          from (select distinct p_brand from part where p_brand <> 'Brand#7'))
       select p_partkey, 'categorical__p_brand' as feature, coalesce(i, -1)::double as value
       from part left join s using (p_brand)""",
)
def ordinal(spark, folder):
    d = table(spark, folder, "part").select("p_partkey", "p_brand")
    seen = d.filter(F.col("p_brand") != "Brand#7")
    fitted = X.fit_features(seen.drop("p_partkey"), FeatureConfig(encoding="ordinal"))
    return fitted.transform_long(d, ["p_partkey"])


@registered(
    "features_impute_scale_encode",
    f"""with f as (select p_partkey, coalesce(p_size, (select quantile_cont(p_size, 0.5) from {PART_SQL})) as a,
            p_retailprice as b, coalesce(p_type, {MODE_SQL}) as t from {PART_SQL})
        select p_partkey, 'numeric__p_size' as feature, round((a - avg(a) over ()) / stddev_pop(a) over (), 6) as value from f
        union all select p_partkey, 'numeric__p_retailprice', round((b - avg(b) over ()) / stddev_pop(b) over (), 6) from f
        union all select p_partkey, 'categorical__p_type_' || s.t, case when f.t = s.t then 1.0 else 0.0 end from f, {TYPES_SQL} s""",
)
def full(spark, folder):
    return fitted_long(spark, folder, FeatureConfig(), ["p_size", "p_retailprice", "p_type"])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@registered(
    "features_select_variance",
    "select feature from ("
    + " union all ".join(
        f"select 'numeric__{c}' as feature, var_pop({c}) as v from lineitem" for c in NUMBERS
    )
    + ") where v > 3.0",
)
def variance(spark, folder):
    d = table(spark, folder, "lineitem").select(*NUMBERS)
    config = FeatureConfig(scaling="none", selection_method="variance", variance_threshold=3.0)
    names = X.fit_features(d, config).names
    return spark.createDataFrame([(n,) for n in names], "feature string")


ANOVA_SQL = " union all ".join(
    f"""select '{c}' as feature, round((sum(n * (m - g) ** 2) / (count(*) - 1))
          / (sum((n - 1) * v) / (sum(n) - count(*))), 4) as score
        from (select count(*) as n, avg({c}) as m, var_samp({c}) as v,
                (select avg({c}) from lineitem) as g from lineitem group by l_returnflag)"""
    for c in NUMBERS
)


def _assembled(spark, folder, label):
    from pyspark.ml.feature import VectorAssembler

    d = table(spark, folder, "lineitem").select(*NUMBERS, label.alias("label"))
    return VectorAssembler(inputCols=NUMBERS, outputCol="v").transform(d)


@registered("features_anova_f_scores", ANOVA_SQL)
def anova(spark, folder):
    code = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    scores = X.anova_f(_assembled(spark, folder, code), "v", "label")
    rows = [(c, float(s)) for c, s in zip(NUMBERS, scores, strict=True)]
    return rounded(spark.createDataFrame(rows, "feature string, score double"), 4)


@registered(
    "features_f_regression_scores",
    " union all ".join(
        f"""select '{c}' as feature, round(corr({c}, y) ** 2 / (1 - corr({c}, y) ** 2) * (count(*) - 2), 3) as score
            from (select *, l_extendedprice / 1000 + l_orderkey % 13 as y from lineitem)"""
        for c in NUMBERS
    ),
)
def f_regression(spark, folder):
    y = F.col("l_extendedprice") / 1000 + F.col("l_orderkey") % 13
    scores = X.f_regression(_assembled(spark, folder, y), "v", "label")
    rows = [(c, float(s)) for c, s in zip(NUMBERS, scores, strict=True)]
    return rounded(spark.createDataFrame(rows, "feature string, score double"), 3)


@registered(
    "features_select_kbest",
    f"select 'numeric__' || feature as feature from ({ANOVA_SQL}) order by score desc limit 2",
)
def kbest(spark, folder):
    d = table(spark, folder, "lineitem").select(
        *NUMBERS,
        F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0)
        .otherwise(2.0).alias("flag"),
    )
    config = FeatureConfig(target="flag", selection_method="kbest", selection_k=2)
    names = X.fit_features(d, config, "flag").names
    return spark.createDataFrame([(n,) for n in names], "feature string")


MANY_CLASSES_SQL = """
    with d as (select cast(l_suppkey % 30 as double) as y, cast((l_suppkey % 30) * 7 % 30 as double) + l_tax as a,
                 cast(l_suppkey % 30 as double) + l_quantity as b from lineitem),
    x as (select y, 'a' as feature, a as v from d union all select y, 'b', b from d),
    g as (select feature, y, count(*) as n, avg(v) as m, var_samp(v) as s from x group by all),
    t as (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as mm from g)
    select feature, (sum(n * (m - mm) ** 2) / (count(*) - 1)) / (sum((n - 1) * s) / (sum(n) - count(*))) as score
    from t group by feature"""


@registered(
    "features_select_kbest_many_classes",
    f"select 'numeric__' || feature as feature from ({MANY_CLASSES_SQL}) order by score desc limit 1",
)
def kbest_many_classes(spark, folder):
    """Thirty class codes are classes, though they are numbers."""
    code = (F.col("l_suppkey") % 30).cast("double")
    d = table(spark, folder, "lineitem").select(
        code.alias("y"), ((F.col("l_suppkey") % 30 * 7 % 30).cast("double") + F.col("l_tax")).alias("a"),
        (code + F.col("l_quantity")).alias("b"),
    )
    config = FeatureConfig(target="y", selection_method="kbest", selection_k=1)
    names = X.fit_features(d, config, "y", "classification").names
    return spark.createDataFrame([(n,) for n in names], "feature string")


@registered(
    "features_pca_explained",
    """select 'pca0' as feature, round((1 + abs(c)) / 2 * n / (n - 1) * 2, 4) as variance from (
         select corr(l_quantity, l_extendedprice) as c, count(*) as n from lineitem)
       union all select 'pca1', round((1 - abs(c)) / 2 * n / (n - 1) * 2, 4) from (
         select corr(l_quantity, l_extendedprice) as c, count(*) as n from lineitem)""",
)
def pca(spark, folder):
    # two standardised columns: the eigenvalues are 1 + |r| and 1 - |r|
    d = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    fitted = X.fit_features(d.drop("l_orderkey"), FeatureConfig(pca_enabled=True))
    long = fitted.transform_long(d, ["l_orderkey"])
    return rounded(long.groupBy("feature").agg(F.var_samp("value").alias("variance")), 4)


@registered(
    "features_pca_onehot",
    """with b as (select p_brand, count(*) as c, (select count(*) from part) as n from part group by 1)
        select count(*) as components, round(sum(c / n::double * (1 - c / n::double)) * max(n) / (max(n) - 1), 6) as variance from b""",
)
def pca_onehot(spark, folder):
    """All directions of one-hot columns hold the variance of these columns, none of it twice."""
    d = table(spark, folder, "part").select("p_partkey", "p_brand")
    fitted = X.fit_features(d.drop("p_partkey"), FeatureConfig(pca_enabled=True))
    long = fitted.transform_long(d, ["p_partkey"])
    spread = long.groupBy("feature").agg(F.var_samp("value").alias("v"))
    return rounded(spread.agg(F.count("*").alias("components"), F.sum("v").alias("variance")))


@registered(
    "features_ordinal_all_distinct",
    """select c_custkey, cast(row_number() over (order by c_name) - 1 as bigint) as ord_c_name,
         cast(dense_rank() over (order by c_mktsegment) - 1 as bigint) as ord_c_mktsegment from customer""",
)
def ordinal_all_distinct(spark, folder):
    """A column with as many categories as rows, beside one with few."""
    d = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    numbers = CategoryNumbers.fit(d, ["c_name", "c_mktsegment"])
    return numbers.ordinal(d).select("c_custkey", "ord_c_name", "ord_c_mktsegment")


@registered(
    "features_onehot_all_distinct",
    """with n as (select c_custkey, c_name, c_mktsegment, row_number() over (order by c_name) - 1 as i, dense_rank() over (order by c_mktsegment) - 1 as k from customer)
       select c_custkey, cast(i as bigint) as place, 'categorical__c_name_' || c_name as name from n
       union all select c_custkey, cast(k + (select count(*) from customer) as bigint), 'categorical__c_mktsegment_' || c_mktsegment from n""",
)
def onehot_all_distinct(spark, folder):
    """The places of the ones of each row, with the names of their features."""
    d = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    numbers = CategoryNumbers.fit(d, ["c_name", "c_mktsegment"])
    ones = numbers.onehot(d).select("c_custkey", F.explode("hot").alias("place"))
    names = numbers.names().withColumnRenamed("index", "place")
    return ones.join(names, "place").select("c_custkey", "place", "name")


@registered("features_preview")
def preview(spark, folder):
    config = FeatureConfig(pca_enabled=True, pca_components=0.9)
    return X.preview_features(part(spark, folder), config, ["p_partkey"]).sample
