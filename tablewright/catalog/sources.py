"""Source, sink and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import registered, table
from tablewright.functions import scalars as L
from tablewright.session import shared_folder
from tablewright.sources import tables as S


@registered(
    "source_csv_round_trip",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders",
)
def csv(spark, folder):
    path = f"{shared_folder(spark)}/orders.CSV"
    orders = table(spark, folder, "orders")
    orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.option(
        "header", True
    ).csv(path)
    return S.read_table(spark, path)


@registered("source_parquet", "select * from customer")
def parquet(spark, folder):
    return S.read_table(spark, f"{folder}/customer.parquet")


@registered(
    "source_versioned_table",
    """select 1 as version, count(*) as n from orders where o_orderstatus = 'F'
       union all select 2, count(*) from orders""",
)
def versioned(spark, folder):
    store = S.VersionedTable(spark, f"{shared_folder(spark)}/orders")
    orders = table(spark, folder, "orders")
    store.write(orders.filter("o_orderstatus = 'F'"))
    store.write(orders)
    first = store.read(1).agg(F.lit(1).alias("version"), F.count("*").alias("n"))
    return first.union(store.read().agg(F.lit(store.versions()[-1]), F.count("*")))


@registered(
    "source_csv_quoted_line_breaks",
    "select doc_id, text, source from documents",
)
def csv_line_breaks(spark, folder):
    """All texts, with line breaks, carriage returns, quotes and commas, written as CSV and read back."""
    path = f"{shared_folder(spark)}/documents.csv"
    d = table(spark, folder, "documents").select("doc_id", "text", "source")
    d.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_csv(spark, path, "doc_id bigint, text string, source string", missing=())


@registered(
    "source_csv_missing_markers",
    """select event_id, case when event_id % 5 > 0 then value end as value,
         case when event_id % 7 > 0 then event_type end as event_type from events""",
)
def csv_missing(spark, folder):
    """Numbers stay numbers, though some cells say NA or null."""
    path = f"{shared_folder(spark)}/events.csv"
    key = F.col("event_id")
    table(spark, folder, "events").select(
        "event_id",
        F.when(key % 5 > 0, F.col("value").cast("string")).when(key % 2 == 0, "NA").otherwise("null").alias("value"),
        F.when(key % 7 > 0, F.col("event_type")).otherwise("N/A").alias("event_type"),
    ).write.option("header", True).csv(path)
    return S.read_csv(spark, path)


def checksum_sql(source: str, columns: list[str]) -> str:
    digest = " || '|' || ".join(
        f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in columns
    )
    return f"""select count(*) as n_rows, sha256(count(*) || '|' || cast(sum(a) as hugeint) || '|' || cast(sum(b) as hugeint)) as checksum
        from (select cast(cast('0x' || substr(md5({digest}), 1, 15) as bigint) as hugeint) as a,
                cast(cast('0x' || substr(md5({digest}), 16, 15) as bigint) as hugeint) as b from {source})"""


@registered(
    "source_version_record",
    f"""select cast(1 as int) as version, n_rows, 4 as n_columns, checksum, 'parquet' as file_type
        from ({checksum_sql("(select p_partkey, p_name, p_brand, p_size from part where p_size > 10)", ["p_partkey", "p_name", "p_brand", "p_size"])})
        union all select 2, n_rows, 4, checksum, 'parquet'
        from ({checksum_sql("part", ["p_partkey", "p_name", "p_brand", "p_size"])})""",
)
def version_record(spark, folder):
    """What is recorded of each version when it is written."""
    store = S.VersionedTable(spark, f"{shared_folder(spark)}/part")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    store.write(part.filter("p_size > 10"))
    store.write(part)
    return store.records().select("version", "n_rows", "n_columns", "checksum", "file_type")


@registered(
    "source_content_checksum", checksum_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"])
)
def checksum(spark, folder):
    return S.content_checksum(table(spark, folder, "documents"))


@registered(
    "source_latest_version",
    """select o_custkey as dataset_id, max(o_orderkey) as version, arg_max(o_orderpriority, o_orderkey) as label
       from orders group by o_custkey""",
)
def latest(spark, folder):
    versions = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("version"),
        F.col("o_orderpriority").alias("label"),
    )
    return S.latest_versions(versions)


@registered(
    "source_file_types",
    """select url, case when lower(url) like '%.csv' or lower(url) like '%.txt' then 'csv' when lower(url) like '%.parquet' then 'parquet' else 'none' end as kind
       from (select c_name || case c_nationkey % 4 when 0 then '.CSV' when 1 then '.txt' when 2 then '.Parquet' else '.doc' end as url from customer)""",
)
def file_types(spark, folder):
    endings = F.element_at(
        F.array(*[F.lit(e) for e in (".CSV", ".txt", ".Parquet", ".doc")]), F.col("c_nationkey") % 4 + 1
    )
    names = table(spark, folder, "customer").select(F.concat("c_name", endings).alias("url"))
    return names.select("url", F.coalesce(S.file_type_of(F.col("url")), F.lit("none")).alias("kind"))


@registered(
    "function_slugify",
    r"""select doc_id, case when s = '' then 'item' else s end as slug from (
      select doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(
        strip_accents(text), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9_ \t\n\x0B\f\r\x1c-\x1f-]', '', 'g')),
        '[- \t\n\x0B\f\r\x1c-\x1f]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 160), '-+$', '') as s from documents)""",
)
def slugify(spark, folder):
    return table(spark, folder, "documents").select("doc_id", L.slugify(F.col("text")).alias("slug"))


@registered(
    "function_numeric_or_null",
    """select event_id, try_cast(case when event_id % 2 = 0 then event_type else cast(event_id as varchar) end as double) as number from events""",
)
def numeric(spark, folder):
    text = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, folder, "events").select("event_id", L.numeric_or_null(text).alias("number"))


@registered(
    "function_rounding",
    "select l_orderkey, l_linenumber, round(l_extendedprice / 7, 4) as four, round(l_extendedprice / 7, 6) as six from lineitem",
)
def rounding(spark, folder):
    seventh = F.col("l_extendedprice") / 7
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(seventh, 4).alias("four"), F.round(seventh, 6).alias("six")
    )


@registered(
    "function_finite_or_null",
    "select event_id, case when event_id % 3 = 0 then value end as value from events",
)
def finite(spark, folder):
    bad = F.when(F.col("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(bad)
    return table(spark, folder, "events").select("event_id", L.finite_or_null(value).alias("value"))


@registered(
    "function_same_ignoring_case",
    "select c_custkey from customer where lower(c_mktsegment) = lower('machinery')",
)
def same(spark, folder):
    customer = table(spark, folder, "customer")
    return customer.filter(L.same_ignoring_case(F.col("c_mktsegment"), "Machinery")).select("c_custkey")


@registered("function_content_digest", "select page_id, sha256(html) as digest from pages")
def digest(spark, folder):
    return table(spark, folder, "pages").select("page_id", L.content_digest(F.col("html")).alias("digest"))


@registered(
    "function_decode_label",
    """select p_partkey, case p_size % 5 when 0 then 'low' when 1 then 'mid' when 2 then 'high' else cast(p_size % 5 as varchar) end as label from part""",
)
def decode(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", L.decode_label(F.col("p_size") % 5, ["low", "mid", "high"]).alias("label")
    )


@registered(
    "function_readable_bytes",
    """select o_orderkey, case when b < 1024 then printf('%.0f B', b) when b < 1024 ** 2 then printf('%.1f KB', round(b / 1024, 1))
         when b < 1024 ** 3 then printf('%.1f MB', round(b / 1024 ** 2, 1)) when b < 1024 ** 4 then printf('%.1f GB', round(b / 1024 ** 3, 1))
         else printf('%.1f TB', round(b / 1024 ** 4, 1)) end as size
       from (select o_orderkey, floor(floor(o_totalprice) * pow(64, o_custkey % 6) / 4096) as b from orders)""",
)
def readable(spark, folder):
    b = F.floor(F.floor("o_totalprice") * F.pow(F.lit(64.0), F.col("o_custkey") % 6) / 4096)
    return table(spark, folder, "orders").select("o_orderkey", L.readable_bytes(b).alias("size"))
