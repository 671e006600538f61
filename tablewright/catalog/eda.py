"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import registered, rounded, table
from tablewright.catalog.profile import (
    GAPPED,
    GAPPED_SQL,
    LINEITEM_NUMBERS,
    _pairs_sql,
    _top_sql,
    gapped,
)
from tablewright.functions.scalars import normalise_missing
from tablewright.operators import eda as E
from tablewright.operators.profile import split_by_kind

BINS = 20


def hash_sql(keys: list[str], seed: int) -> str:
    """The order key of ``order_hash`` in SQL, for keys that are not null."""
    parts = " || '|' || ".join([*[f"cast({k} as varchar)" for k in keys], f"'{seed}'"])
    return f"cast('0x' || substr(md5({parts}), 1, 15) as bigint)"


@registered(
    "eda_missing_bars",
    f"""select * from ({' union all '.join(f'''select '{c}' as "column", count(*) - count({c}) as n_missing from ({GAPPED_SQL})''' for c in [*GAPPED, 'status_gap', 'is_big'])})
        where n_missing > 0""",
)
def missing(spark, folder):
    return E.missing_bars(gapped(spark, folder).select(*GAPPED, "status_gap", "is_big"))


def _histogram_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", cast(b.bin as int) as bin, round(lo + (hi - lo) / {BINS} * b.bin, 6) as low,
              round(lo + (hi - lo) / {BINS} * (b.bin + 1), 6) as high, coalesce(n, 0) as count
            from (select unnest(range({BINS})) as bin) b
            cross join (select min({c})::double as lo, max({c})::double as hi from ({source})) r
            left join (select case when hi > lo then least(cast(floor((v - lo) / (hi - lo) * {BINS}) as int), {BINS - 1}) else 0 end as bin,
                         count(*) as n
                       from (select {c}::double as v, min({c}) over ()::double as lo, max({c}) over ()::double as hi
                             from ({source})) where v is not null group by 1) c on c.bin = b.bin"""
        for c in columns
    )


@registered("eda_histograms_lineitem", _histogram_sql("from lineitem", LINEITEM_NUMBERS))
def histograms_lineitem(spark, folder):
    return rounded(E.histograms(table(spark, folder, "lineitem"), bins=BINS))


@registered("eda_histograms_missing_values", _histogram_sql(GAPPED_SQL, GAPPED))
def histograms_gapped(spark, folder):
    return rounded(E.histograms(gapped(spark, folder), GAPPED, bins=BINS))


@registered(
    "eda_box_plots_missing_values",
    " union all ".join(
        f"""select '{c}' as "column", round(min(v), 6) as min,
              round(min(v) filter (where v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_low,
              round(max(q1), 6) as p25, round(max(q2), 6) as median, round(max(q3), 6) as p75,
              round(max(v) filter (where v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_high,
              round(max(v), 6) as max,
              count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers
            from (select {c} as v, quantile_cont({c}, 0.25) over () as q1, quantile_cont({c}, 0.5) over () as q2,
                    quantile_cont({c}, 0.75) over () as q3 from ({GAPPED_SQL}))"""
        for c in GAPPED
    ),
)
def boxes(spark, folder):
    return rounded(E.box_plots(gapped(spark, folder), GAPPED))


@registered(
    "eda_category_bars_events",
    f"""select "column", rank, value, count from ({_top_sql('from events', ['event_type', 'props'], 15)})""",
)
def categories(spark, folder):
    return E.category_bars(normalise_missing(table(spark, folder, "events")))


@registered(
    "eda_correlation_heatmap_missing_values",
    f"""with p as ({_pairs_sql(GAPPED_SQL, GAPPED)})
        select a, b, round(correlation, 6) as correlation from p
        union all select b, a, round(correlation, 6) from p
        union all select c, c, case when c <> 'flat' then 1.0 end from (select unnest({GAPPED}) as c)""",
)
def heatmap(spark, folder):
    return rounded(E.correlation_heatmap(gapped(spark, folder), GAPPED))


@registered(
    "eda_strongest_pair_lineitem",
    f"""select a, b, round(correlation, 6) as correlation
        from ({_pairs_sql('from lineitem', LINEITEM_NUMBERS)}) where correlation is not null
        order by abs(correlation) desc, i, j limit 1""",
)
def strongest(spark, folder):
    return rounded(E.strongest_pair(table(spark, folder, "lineitem")))


@registered(
    "eda_scatter_sample_orders",
    f"""select o_orderkey, o_custkey, o_totalprice from orders
        order by {hash_sql(['o_orderkey'], 42)}, o_orderkey limit 2000""",
)
def scatter(spark, folder):
    return E.scatter_sample(
        table(spark, folder, "orders"), "o_custkey", "o_totalprice", key=["o_orderkey"]
    )


@registered(
    "eda_column_split_orders",
    """select 'numeric' as kind, unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) as "column"
       where (select count(*) from orders) > 0
       union all select 'categorical', 'o_orderstatus' from orders
         having count(distinct o_orderstatus) <= 0.5 * count(o_orderstatus)
       union all select 'categorical', 'o_orderpriority' from orders
         having count(distinct o_orderpriority) <= 0.5 * count(o_orderpriority)""",
)
def column_split(spark, folder):
    kinds = split_by_kind(table(spark, folder, "orders"))
    rows = [("numeric", c) for c in kinds.numeric] + [("categorical", c) for c in kinds.categorical]
    return spark.createDataFrame(rows, "kind string, column string")


@registered("eda_chart_bundle_part")
def bundle(spark, folder):
    charts = E.chart_data(table(spark, folder, "part"), bins=BINS, key=["p_partkey"])
    parts = [
        charts.missing.select(F.lit("missing").alias("chart"), "column", F.col("n_missing").cast("string").alias("label"), F.col("n_missing").cast("double").alias("value")),
        charts.correlations.select(F.lit("heatmap"), "a", "b", "correlation"),
        charts.histograms.select(F.lit("histogram"), "column", F.col("bin").cast("string"), F.col("count").cast("double")),
        charts.box_plots.select(F.lit("box"), "column", F.lit("median"), "median"),
        charts.categories.select(F.lit("category"), "column", "value", F.col("count").cast("double")),
    ]
    if charts.scatter is not None:
        x, y = charts.scatter.columns[-2:]
        parts.append(
            charts.scatter.select(F.lit("scatter"), F.lit(y), F.col(x).cast("string"), F.col(y).cast("double"))
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result
