"""Profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.catalog.base import registered, rounded, table
from tablewright.functions.scalars import normalise_missing, quoted
from tablewright.operators import profile as P

# Column lists of the given tables, used to write the SQL side.
LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
GAPPED = ["c_acctbal", "o_totalprice", "gap_a", "gap_b", "flat"]

# customer joined to its orders, with holes, a NaN source and a constant: the missing-value cases
GAPPED_SQL = """
    select c.c_custkey, c.c_mktsegment, c.c_acctbal, o.o_totalprice,
           case when o.o_orderkey % 3 = 0 then o.o_totalprice end as gap_a,
           case when o.o_orderkey % 5 <> 0 then c.c_acctbal end as gap_b,
           cast(7 as double) as flat,
           case when o.o_orderkey % 4 = 0 then o.o_orderstatus end as status_gap,
           o.o_totalprice > 250000 as is_big
    from customer c left join orders o on c.c_custkey = o.o_custkey
"""


def gapped(spark, folder) -> DataFrame:
    """Customers with their orders, some values removed (as NULL or NaN)."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    )
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    nan = F.lit(float("nan"))
    return normalise_missing(
        joined.select(
            "c_custkey",
            "c_mktsegment",
            "c_acctbal",
            "o_totalprice",
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(nan).alias("gap_a"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("c_acctbal")).alias("gap_b"),
            F.lit(7.0).alias("flat"),
            F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("status_gap"),
            (F.col("o_totalprice") > 250000).alias("is_big"),
        )
    )


def _numeric_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"""
    select {i} as position, '{c}' as "column", count(v) as count,
      round(avg(v), 4) as mean,
      round(case when count(v) > 1 then stddev_samp(v) when count(v) = 1 then 0.0 end, 4) as std,
      round(min(v), 4) as min, round(max(q1), 4) as p25, round(max(q2), 4) as median,
      round(max(q3), 4) as p75, round(max(v), 4) as max,
      round(case when count(v) > 2 then coalesce(case when min(v) < max(v) then skewness(v) end, 0.0)
                 when count(v) > 0 then 0.0 end, 4) as skew,
      round(case when count(v) > 3 then coalesce(case when min(v) < max(v) then kurtosis(v) end, 0.0)
                 when count(v) > 0 then 0.0 end, 4) as kurtosis,
      count(*) filter (where v = 0) as n_zeros,
      count(*) filter (where v < 0) as n_negative,
      count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers
    from (select cast({c} as double) as v, quantile_cont(cast({c} as double), 0.25) over () as q1,
                 quantile_cont(cast({c} as double), 0.5) over () as q2,
                 quantile_cont(cast({c} as double), 0.75) over () as q3 from ({source}))"""
        )
    return " union all ".join(parts)


@registered("profile_numeric_lineitem", _numeric_sql("from lineitem", LINEITEM_NUMBERS))
def numeric_lineitem(spark, folder):
    return rounded(P.numeric_summary(normalise_missing(table(spark, folder, "lineitem"))), 4)


@registered("profile_numeric_missing_values", _numeric_sql(GAPPED_SQL, GAPPED))
def numeric_gapped(spark, folder):
    return rounded(P.numeric_summary(gapped(spark, folder), GAPPED), 4)


def _schema_sql(source: str, columns: list[tuple[str, str, str]]) -> str:
    parts = []
    for i, (c, dtype, family) in enumerate(columns):
        kind = (
            f"case when count({c}) = 0 or count(distinct {c})::double / count({c}) <= 0.5 "
            "then 'categorical' else 'text' end"
            if family == "text"
            else f"'{family}'"
        )
        parts.append(
            f"""select {i} as position, '{c}' as "column", '{dtype}' as dtype,
            {kind} as inferred_type, count(*) - count({c}) as n_missing,
            round(100.0 * (count(*) - count({c})) / count(*), 4) as missing_pct,
            count(distinct {c}) as n_unique from ({source})"""
        )
    return " union all ".join(parts)


@registered(
    "profile_column_schema_orders",
    _schema_sql(
        "from orders",
        [
            ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
            ("o_orderstatus", "string", "text"), ("o_totalprice", "double", "numeric"),
            ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "text"),
        ],
    ),
)
def schema_orders(spark, folder):
    return P.column_schema(normalise_missing(table(spark, folder, "orders")))


@registered(
    "profile_column_schema_documents",
    _schema_sql(
        "from documents",
        [
            ("doc_id", "bigint", "numeric"), ("text", "string", "text"),
            ("lang", "string", "text"), ("source", "string", "text"),
            ("n_chars", "bigint", "numeric"),
        ],
    ),
)
def schema_documents(spark, folder):
    return P.column_schema(normalise_missing(table(spark, folder, "documents")))


@registered(
    "profile_column_schema_missing_values",
    _schema_sql(
        GAPPED_SQL,
        [
            ("c_custkey", "bigint", "numeric"), ("c_mktsegment", "string", "text"),
            ("c_acctbal", "double", "numeric"), ("o_totalprice", "double", "numeric"),
            ("gap_a", "double", "numeric"), ("gap_b", "double", "numeric"),
            ("flat", "double", "numeric"), ("status_gap", "string", "text"),
            ("is_big", "boolean", "boolean"),
        ],
    ),
)
def schema_gapped(spark, folder):
    return P.column_schema(gapped(spark, folder))


@registered(
    "profile_semantic_types_events",
    _schema_sql(
        "from events",
        [
            ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"),
            ("user_id", "bigint", "numeric"), ("event_type", "string", "text"),
            ("value", "double", "numeric"), ("props", "string", "text"),
        ],
    ).replace("select 0 as", "select * from (select 0 as", 1) + ")",
)
def types_events(spark, folder):
    return P.column_schema(normalise_missing(table(spark, folder, "events")))


def _outlier_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count(*) filter (where v < q1 - 1.5 * (q3 - q1)
               or v > q3 + 1.5 * (q3 - q1)) as n_outliers
            from (select {c} as v, quantile_cont(cast({c} as double), 0.25) over () as q1,
                  quantile_cont(cast({c} as double), 0.75) over () as q3 from ({source}))"""
        for c in columns
    )


@registered(
    "profile_flag_outliers_events",
    """select event_id, value, value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)
          as value_outlier
       from (select event_id, value, quantile_cont(value, 0.25) over () as q1,
             quantile_cont(value, 0.75) over () as q3 from events)""",
)
def outliers_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return P.flag_outliers(events, ["value"])


def _top_sql(source: str, columns: list[str], k: int) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", n_unique, rank, value, count,
              round(100.0 * count / total, 4) as pct
            from (select value, count, sum(count) over () as total, count(*) over () as n_unique,
                    row_number() over (order by count desc, value) as rank
                  from (select {_text(c)} as value, count(*) as count from ({source})
                        where {c} is not null group by 1)) where rank <= {k}"""
        for c in columns
    )


def _text(column: str) -> str:
    if column == "is_big":
        return "case when is_big then 'True' else 'False' end"
    return f"cast({column} as varchar)"


@registered(
    "profile_top_values_events", _top_sql("from events", ["event_type", "props"], 10)
)
def top_events(spark, folder):
    return P.top_values(normalise_missing(table(spark, folder, "events")))


@registered(
    "profile_top_values_missing_values",
    _top_sql(GAPPED_SQL, ["c_mktsegment", "status_gap", "is_big"], 10),
)
def top_gapped(spark, folder):
    return P.top_values(gapped(spark, folder))


@registered(
    "profile_value_counts_part",
    " union all ".join(
        f"""select '{c}' as "column", cast({c} as varchar) as value, count(*) as count
            from part where {c} is not null group by 2"""
        for c in ["p_name", "p_brand", "p_type", "p_size"]
    ),
)
def counts_part(spark, folder):
    return P.value_counts(table(spark, folder, "part"), ["p_name", "p_brand", "p_type", "p_size"])


def corr_sql(x: str, y: str) -> str:
    """Pearson over the complete rows, NULL where one side is constant."""
    return (
        f"case when stddev_samp(case when {y} is not null then {x} end) > 0 and "
        f"stddev_samp(case when {x} is not null then {y} end) > 0 then corr({x}, {y}) end"
    )


def _pairs_sql(source: str, columns: list[str]) -> str:
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return " union all ".join(
        f"select {i} as i, {j} as j, '{columns[i]}' as a, '{columns[j]}' as b, "
        f"{corr_sql(columns[i], columns[j])} as correlation from ({source})"
        for i, j in pairs
    )


@registered(
    "profile_correlation_matrix_lineitem",
    f"""with p as ({_pairs_sql('from lineitem', LINEITEM_NUMBERS)})
        select a, b, round(correlation, 6) as correlation from p
        union all select b, a, round(correlation, 6) from p
        union all select unnest({LINEITEM_NUMBERS}) as a, a as b, 1.0""".replace(
        "unnest(" + str(LINEITEM_NUMBERS) + ") as a, a as b, 1.0",
        "c, c, 1.0 from (select unnest(" + str(LINEITEM_NUMBERS) + ") as c)",
    ),
)
def matrix_lineitem(spark, folder):
    return rounded(P.correlation_matrix(table(spark, folder, "lineitem")))


@registered(
    "profile_correlation_missing_values",
    f"select i, j, a, b, round(correlation, 6) as correlation from ({_pairs_sql(GAPPED_SQL, GAPPED)})",
)
def pairs_gapped(spark, folder):
    return rounded(P.correlation_pairs(gapped(spark, folder), GAPPED))


@registered(
    "profile_strongest_pairs_lineitem",
    f"""select a, b, round(correlation, 6) as correlation
        from ({_pairs_sql('from lineitem', LINEITEM_NUMBERS)}) where correlation is not null
        order by abs(correlation) desc, i, j limit 15""",
)
def strongest_lineitem(spark, folder):
    return rounded(P.strongest_pairs(table(spark, folder, "lineitem")))


@registered(
    "profile_duplicate_rows_part",
    """select (select count(*) from part) - (select count(*) from
         (select distinct p_name, p_brand, p_type, p_size from part)) as n_duplicate_rows""",
)
def duplicates_part(spark, folder):
    return P.duplicate_rows(
        table(spark, folder, "part").select("p_name", "p_brand", "p_type", "p_size")
    )


@registered(
    "profile_duplicate_texts_documents",
    """select (select count(*) from documents) - (select count(*) from
         (select distinct text, lang, source, n_chars from documents)) as n_duplicate_rows""",
)
def duplicates_documents(spark, folder):
    return P.duplicate_rows(table(spark, folder, "documents").drop("doc_id"))


@registered(
    "profile_overview_missing_values",
    f"""with g as ({GAPPED_SQL}), m as (select count(*) as n,
          {' + '.join(f'(count(*) - count({c}))' for c in ['c_custkey', 'c_mktsegment', *GAPPED, 'status_gap', 'is_big'])} as cells,
          sum(coalesce(strlen(c_mktsegment), 0) + coalesce(strlen(status_gap), 0))
          + {' + '.join(f'8 * count({c})' for c in ['c_custkey', *GAPPED])} + count(is_big) as bytes from g)
        select n as n_rows, 9 as n_columns, n - (select count(*) from (select distinct * from g)) as n_duplicate_rows,
          cast(bytes as bigint) as memory_bytes, cells as missing_cells,
          round(100.0 * cells / (n * 9), 4) as missing_cells_pct, 6 as n_numeric, 3 as n_categorical
        from m""",
)
def overview_gapped(spark, folder):
    return P.overview(gapped(spark, folder))


@registered(
    "profile_overview_lineitem",
    f"""select count(*) as n_rows, 11 as n_columns,
          count(*) - (select count(*) from (select distinct * from lineitem)) as n_duplicate_rows,
          cast(count(*) * (3 * 8 + 4 + 4 * 8 + 8) + sum(strlen(l_returnflag) + strlen(l_linestatus)) as bigint) as memory_bytes,
          0 as missing_cells, 0.0 as missing_cells_pct, 8 as n_numeric, 2 as n_categorical
        from lineitem""",
)
def overview_lineitem(spark, folder):
    return P.overview(normalise_missing(table(spark, folder, "lineitem")))


@registered(
    "profile_missing_by_column",
    f"""select * from ({' union all '.join(f'''select '{c}' as "column", count(*) - count({c}) as n_missing from ({GAPPED_SQL})''' for c in ['c_custkey', 'c_mktsegment', *GAPPED, 'status_gap', 'is_big'])})
        where n_missing > 0""",
)
def missing_gapped(spark, folder):
    return P.missing_by_column(gapped(spark, folder))


@registered(
    "profile_full_customer",
    f"""select "column", 'mean' as statistic, mean as value
        from ({_numeric_sql('from customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])})
        union all select "column", 'n_outliers', n_outliers
        from ({_numeric_sql('from customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])})
        union all select "column", 'n_unique', n_unique
        from ({_schema_sql('from customer', [('c_custkey', 'bigint', 'numeric'), ('c_name', 'string', 'text'), ('c_nationkey', 'int', 'numeric'), ('c_acctbal', 'double', 'numeric'), ('c_mktsegment', 'string', 'text')])})
        union all select "column" || ':' || value, 'count', count
        from ({_top_sql('from customer', ['c_mktsegment'], 10)})
        union all select a || ':' || b, 'correlation', round(correlation, 4)
        from ({_pairs_sql('from customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])})""",
)
def full_customer(spark, folder):
    profile = P.profile_table(table(spark, folder, "customer"))
    name, pair = F.col("column"), F.concat_ws(":", "a", "b")
    parts = [
        profile.numeric.select(name, F.lit("mean").alias("statistic"), F.col("mean").alias("value")),
        profile.numeric.select(name, F.lit("n_outliers"), F.col("n_outliers").cast("double")),
        profile.columns.select(name, F.lit("n_unique"), F.col("n_unique").cast("double")),
        profile.top_values.select(
            F.concat_ws(":", name, "value"), F.lit("count"), F.col("count").cast("double")
        ),
        profile.top_pairs.select(pair, F.lit("correlation"), F.col("correlation")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return rounded(result, 4)
