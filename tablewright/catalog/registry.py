"""Metadata queries; the given tables stand in for projects, runs, models and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.base import registered, rounded, table
from tablewright.catalog.eda import hash_sql
from tablewright.plans import registry as R
from tablewright.session import shared_folder


@registered(
    "registry_equality_filter",
    "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'",
)
def equality(spark, folder):
    rows = R.equal_to(
        table(spark, folder, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT",
        no_such_column=1, o_custkey=None,
    )
    return rows.select("o_orderkey", "o_custkey")


@registered(
    "registry_lookup_and_count",
    """select count(*) > 0 as found, count(*) as n, (select c_name from customer where c_custkey = 7) as name
       from customer where c_mktsegment = 'MACHINERY'""",
)
def lookup(spark, folder):
    customer = table(spark, folder, "customer")
    one = R.find(customer, c_custkey=7).select("c_name").first()
    row = (R.exists(customer, c_mktsegment="MACHINERY"), R.count(customer, c_mktsegment="MACHINERY"), one["c_name"])
    return spark.createDataFrame([row], "found boolean, n bigint, name string")


@registered(
    "registry_search",
    """select p_partkey, p_name, p_type from part where p_name ilike '%R_nG%' or p_type ilike '%R_nG%'""",
)
def search(spark, folder):
    rows = R.search(table(spark, folder, "part"), "R_nG", ["p_name", "p_type", "no_such_column"])
    return rows.select("p_partkey", "p_name", "p_type")


@registered(
    "registry_page_sorted",
    """select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'
       order by o_totalprice desc, o_orderkey limit 50 offset 100""",
)
def page(spark, folder):
    rows = R.equal_to(table(spark, folder, "orders"), o_orderstatus="O")
    params = R.PageParams(page=3, size=50, sort_by="o_totalprice")
    return R.page_items(rows, params, "o_orderkey").select("o_orderkey", "o_totalprice")


@registered(
    "registry_page_default_order",
    """select o_orderkey, o_orderdate as created_at from orders order by o_orderdate desc, o_orderkey limit 20""",
)
def page_default(spark, folder):
    rows = table(spark, folder, "orders").withColumnRenamed("o_orderdate", "created_at")
    return R.page_items(rows, R.PageParams(sort_by="unknown"), "o_orderkey").select("o_orderkey", "created_at")


@registered(
    "registry_page_position",
    """select 3 as page, 50 as size, count(*) as total, cast(ceil(count(*) / 50.0) as bigint) as pages,
         3 < ceil(count(*) / 50.0) as has_next, true as has_prev from orders where o_orderstatus = 'O'""",
)
def page_position(spark, folder):
    rows = R.equal_to(table(spark, folder, "orders"), o_orderstatus="O")
    return R.page_position(rows, R.PageParams(page=3, size=50, sort_by="o_totalprice"))


@registered(
    "registry_page_walk",
    "select o_orderstatus as status, count(*) as n, count(*) as distinct_rows from orders where o_custkey % 40 = 0 group by 1",
)
def page_walk(spark, folder):
    """All pages of a column of three values, one after another: each row once."""
    rows = table(spark, folder, "orders").filter("o_custkey % 40 = 0").select("o_orderkey", "o_orderstatus").persist()
    pages = R.page_position(rows, R.PageParams(size=100)).first()["pages"]
    found = R.page_items(rows, R.PageParams(size=100, sort_by="o_orderstatus"), through=pages)
    return found.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_rows")
    )


@registered(
    "registry_page_deep",
    """select l_orderkey, l_linenumber, l_shipdate from lineitem
       order by l_shipdate desc, cast(l_orderkey * 10 + l_linenumber as bigint)
       limit 100 offset 100 * (99 * ((select count(*) from lineitem) // 150) // 100)""",
)
def page_deep(spark, folder):
    """A page two thirds down a column of ties."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id")
    )
    page = 99 * (rows.count() // 150) // 100 + 1
    return R.page_items(rows, R.PageParams(page=page, size=100, sort_by="l_shipdate")).drop("id")


STORE_SQL = """with v as (select p_partkey as id, p_name as name, p_size as size, 1 as updated_at, false as removed from part
        union all select p_partkey, 'new ' || p_name, p_size, 2, false from part where p_size % 3 = 0
        union all select p_partkey, 'new ' || p_name, p_size, 3, true from part where p_size = 6
        union all select p_partkey, p_name, p_size, 3, true from part where p_size = 7
        union all select p_partkey, 'last ' || p_name, p_size, 4, false from part where p_size in (6, 8)),
    s as (select * from (select *, row_number() over (partition by id order by updated_at desc) as r from v) where r = 1 and not removed)"""


def _store(spark, folder, compact):
    store = R.RowStore(spark, f"{shared_folder(spark)}/parts")
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(1).alias("updated_at")
    )
    store.append(part)
    renamed = part.filter("size % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name"))
    store.append(renamed.withColumn("updated_at", F.lit(2)))
    gone = store.delete(part.filter("size in (6, 7)").select("id"), F.lit(3))
    if compact:
        store.compact()
    last = part.filter("size in (6, 8)").withColumn("name", F.concat(F.lit("last "), "name"))
    store.append(last.withColumn("updated_at", F.lit(4)))
    return store, gone


@registered("registry_delete_by_id", "select count(*) as deleted from part where p_size in (6, 7)")
def delete_by_id(spark, folder):
    _, gone = _store(spark, folder, False)
    return spark.createDataFrame([(gone,)], "deleted bigint")


@registered("registry_snapshot_state", STORE_SQL + " select id, name, size, updated_at from s")
def snapshot_state(spark, folder):
    """Rows changed, removed, folded into a snapshot, and changed again."""
    store, _ = _store(spark, folder, True)
    return store.state().select("id", "name", "size", "updated_at")


@registered("registry_live_rows", "select p_partkey from part where not (p_size > 25)")
def live_rows(spark, folder):
    rows = table(spark, folder, "part").withColumn(
        "deleted_at", F.when(F.col("p_size") > 25, F.current_timestamp())
    )
    return R.live(rows).select("p_partkey")


@registered(
    "registry_owner_scope",
    """select 'owner' as scope, s_suppkey from supplier where cast(s_nationkey as varchar) = '7'
       union all select 'superuser', s_suppkey from supplier""",
)
def owner_scope(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("owner_id"))
    own = R.owned_by(rows, "7").select(F.lit("owner").alias("scope"), "s_suppkey")
    return own.union(R.owned_by(rows, "7", superuser=True).select(F.lit("superuser"), "s_suppkey"))


@registered(
    "registry_current_state",
    """select user_id as id, event_id, event_type, value from (select *, row_number() over
         (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 and event_type <> 'error'""",
)
def current(spark, folder):
    versions = table(spark, folder, "events").select(
        F.col("user_id").alias("id"), "event_id", "ts", "event_type", "value",
        (F.col("event_type") == "error").alias("removed"),
    )
    return R.current_state(versions, at=["ts", "event_id"]).drop("ts")


NOTES_SQL = """select event_id as id, user_id, case when event_type = 'click' then ts end as read_at from events"""


def notes(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type") == "click", F.col("ts")).alias("read_at")
    )


@registered(
    "registry_mark_all_read",
    f"""select id, user_id, case when user_id = 5 and read_at is null then timestamp '2024-02-01' else read_at end as read_at,
          user_id = 5 and read_at is null as changed from ({NOTES_SQL})""",
)
def mark_all(spark, folder):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return R.marked_read(notes(spark, folder), 5, now)


@registered(
    "registry_unread_list",
    f"select id, user_id from ({NOTES_SQL}) where user_id = 5 and read_at is null order by id desc limit 20 offset 20",
)
def unread_list(spark, folder):
    rows = R.unread(notes(spark, folder), 5)
    return R.page_items(rows, R.PageParams(page=2, sort_by="id")).select("id", "user_id")


@registered(
    "registry_unread_counts",
    f"select user_id, count(*) filter (where read_at is null) as unread from ({NOTES_SQL}) group by user_id",
)
def unread_counts(spark, folder):
    return R.unread_counts(notes(spark, folder))


@registered(
    "registry_with_parent",
    """select c_custkey, n_name as parent_n_name, n_regionkey as parent_n_regionkey from customer
       left join nation on c_nationkey = n_nationkey""",
)
def with_parent(spark, folder):
    rows = R.with_parent(
        table(spark, folder, "customer"), table(spark, folder, "nation"), "c_nationkey", "n_nationkey"
    )
    return rows.select("c_custkey", "parent_n_name", "parent_n_regionkey")


@registered(
    "registry_with_children",
    """select c_custkey, o_orderkey as child_o_orderkey, o_orderdate as child_o_orderdate from customer
       left join orders on c_custkey = o_custkey""",
)
def with_children(spark, folder):
    rows = R.with_children(
        table(spark, folder, "customer"), table(spark, folder, "orders"), "o_custkey",
        [F.col("child_o_orderdate").desc()], "c_custkey",
    )
    return rows.select("c_custkey", "child_o_orderkey", "child_o_orderdate")


@registered(
    "registry_next_versions",
    "select p_brand, p_type, max(p_size) + 1 as next_version from part group by all",
)
def next_versions(spark, folder):
    return R.next_versions(table(spark, folder, "part"), ["p_brand", "p_type"], "p_size")


# every order is a run; its customer is the experiment, the nation the project
@registered(
    "registry_register_models",
    """with a as (select o_orderkey as run_id, o_orderdate, c_nationkey as project_id,
           lower(replace(o_orderpriority, ' ', '-')) as slug
         from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'F' and o_orderkey % 3 > 0),
       m as (select s_nationkey as project_id, '1-urgent' as slug, max(s_suppkey) as top from supplier group by 1)
       select project_id, slug, count(*) as registered, min(version) as first_version, max(version) as last_version,
          count(distinct version) as versions, sum(case when v2 < o_orderdate then 1 else 0 end) as out_of_order
       from (select a.*, coalesce(top, 0) + row_number() over (partition by project_id, slug order by o_orderdate, run_id) as version,
                null::timestamp as v2 from a left join m using (project_id, slug)) group by project_id, slug""",
)
def register(spark, folder):
    requests, runs, experiments, models = _registering(spark, folder)
    made = R.register_models(requests, runs, experiments, models)
    # versions must follow the request time: compare each version with the one before it
    from pyspark.sql.window import Window

    before = F.max("requested_at").over(
        Window.partitionBy("project_id", "slug").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    )
    return made.withColumn("_before", before).groupBy("project_id", "slug").agg(
        F.count("*").alias("registered"), F.min("version").alias("first_version"),
        F.max("version").alias("last_version"), F.countDistinct("version").alias("versions"),
        F.count_if(F.col("_before") > F.col("requested_at")).alias("out_of_order"),
    )


def _registering(spark, folder):
    """Requests, runs, experiments and models; each fourth request of each day also deploys."""
    orders = table(spark, folder, "orders")
    runs = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("experiment_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("runs/"), "o_orderkey")).alias("artifact"),
    )
    experiments = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"),
        F.lit("regression").alias("task"), F.lit("price").alias("target_column"), F.lit("r2").alias("primary_metric"),
    )
    requests = orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("name"),
        F.col("o_orderdate").alias("requested_at"),
    )
    models = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("project_id"), F.lit("1-urgent").alias("slug"), F.col("s_suppkey").alias("version")
    )
    return requests, runs, experiments, models


DEPLOY_SQL = f"""with a as (select o_orderkey as run_id, o_orderdate, o_orderkey % 4 = 0 as deploy, o_clerk_id as user_id, c_nationkey as project_id,
           lower(replace(o_orderpriority, ' ', '-')) as slug, o_orderpriority as name
         from (select *, o_custkey % 10 as o_clerk_id from orders) join customer on o_custkey = c_custkey where o_orderstatus <> 'F' and o_orderkey % 3 > 0),
       m as (select s_nationkey as project_id, '1-urgent' as slug, max(s_suppkey) as top from supplier group by 1),
       v as (select a.*, coalesce(top, 0) + row_number() over (partition by project_id, slug order by o_orderdate, {hash_sql(["run_id"], 42)}, run_id) as version
             from a left join m using (project_id, slug)),
       s as (select project_id, slug, max(version) as serving, min(version) as first from v where deploy group by all)"""


@registered(
    "registry_register_deploy",
    DEPLOY_SQL
    + """ select 'model' as kind, run_id as id, case when not deploy then 'none' when version = serving then 'production' else 'archived' end as value
             from v left join s using (project_id, slug)
        union all select 'change', s_suppkey, 'archived' from supplier join s on s_nationkey = project_id and slug = '1-urgent' where s_suppkey % 5 = 0
        union all select 'note to ' || user_id, run_id, name || ' version ' || version || ' is in production' from v where deploy""",
)
def register_deploy(spark, folder):
    """New models with their stages, older ones that are replaced, and who is told."""
    requests, runs, experiments, models = _registering(spark, folder)
    users = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10).alias("user_id"))
    requests = requests.join(users, "run_id").withColumn("deploy", F.col("run_id") % 4 == 0)
    models = models.withColumn("id", F.col("version")).withColumn("stage", F.when(F.col("version") % 5 == 0, "production").otherwise("none"))
    made = R.register_and_deploy(requests, runs, experiments, models)
    return (
        made.models.select(F.lit("model").alias("kind"), F.col("run_id").cast("bigint").alias("id"), F.col("stage").alias("value"))
        .unionByName(made.changes.select(F.lit("change").alias("kind"), F.col("model_id").cast("bigint").alias("id"), F.col("stage").alias("value")))
        .unionByName(made.notifications.select(
            F.concat(F.lit("note to "), "user_id").alias("kind"), F.col("subject_id").cast("bigint").alias("id"), F.col("message").alias("value")
        ))
    )


STAGE_SQL = """case event_type when 'click' then 'production' when 'view' then 'staging'
    when 'purchase' then 'production' else 'archived' end"""


@registered(
    "registry_model_stages",
    f"""with ch as (select user_id as model_id, {STAGE_SQL} as stage, event_id as stamp from events),
        l as (select model_id as id, arg_max(stage, stamp) as s from ch group by 1),
        d as (select c_nationkey as project_id, c_mktsegment as slug, arg_max(model_id, stamp) as serving
              from ch join customer on model_id = c_custkey where stage = 'production' group by 1, 2)
        select c_custkey as id, c_nationkey as project_id, c_mktsegment as slug,
          case when s is null then 'none' when s = 'production' and serving <> c_custkey then 'archived' else s end as stage
        from customer left join l on l.id = c_custkey left join d on d.project_id = c_nationkey and d.slug = c_mktsegment""",
)
def stages(spark, folder):
    models = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"),
        F.col("c_mktsegment").alias("slug"), F.lit("none").alias("stage"),
    )
    kind = F.col("event_type")
    changes = table(spark, folder, "events").select(
        F.col("user_id").alias("model_id"),
        F.when(kind.isin("click", "purchase"), "production").when(kind == "view", "staging")
        .otherwise("archived").alias("stage"),
        F.col("event_id").alias("at"),
    )
    return R.model_stages(models, changes)


@registered(
    "registry_compare_models",
    "select metric, "
    + ", ".join(
        f"""max(case when c_custkey = {i} then case metric when 'accuracy' then round(c_acctbal / 10000, 6)
            when 'r2' then round(c_nationkey / 25.0, 6) end end) as "{i}" """
        for i in (3, 5, 8)
    )
    + """ from customer, (select unnest(['accuracy', 'f1_weighted', 'roc_auc', 'r2', 'rmse', 'mae']) as metric)
         where c_custkey in (3, 5, 8) group by metric""",
)
def compare(spark, folder):
    models = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.create_map(
            F.lit("accuracy"), F.col("c_acctbal") / 10000, F.lit("r2"), F.col("c_nationkey") / 25
        ).alias("metrics"),
        F.when(F.col("c_custkey") % 3 == 1, F.current_timestamp()).alias("deleted_at"),
    )
    return rounded(R.compare_models(models, [3, 5, 8]))


@registered(
    "registry_deploy_archives_previous",
    """with ch as (select user_id as model_id, event_id as stamp from events where event_type = 'purchase'),
        m as (select c_custkey as id, c_nationkey as project_id, c_mktsegment as slug,
                case when c_custkey % 5 = 0 then 'production' when c_custkey % 5 = 1 then 'staging' else 'none' end as stored from customer),
        l as (select distinct model_id as id from ch),
        d as (select project_id, slug, arg_max(id, stamp) as serving from ch join m on model_id = id group by 1, 2)
        select m.id, m.project_id, m.slug,
          case when (l.id is not null or stored = 'production') and serving <> m.id then 'archived'
               when l.id is not null then 'production' else stored end as stage
        from m left join l on l.id = m.id left join d on d.project_id = m.project_id and d.slug = m.slug""",
)
def deploys(spark, folder):
    """Models with a stored stage; deploying one archives what was in production."""
    key = F.col("c_custkey")
    models = table(spark, folder, "customer").select(
        key.alias("id"), F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("slug"),
        F.when(key % 5 == 0, "production").when(key % 5 == 1, "staging").otherwise("none").alias("stage"),
    )
    changes = table(spark, folder, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("model_id"), F.lit("production").alias("stage"), F.col("event_id").alias("at")
    )
    return R.model_stages(models, changes)


LOG_SQL = """select event_id as id, case when event_type = 'view' then 'GET' else 'POST' end as method,
    case when event_id % 11 = 0 then '/api/v1/' when event_id % 3 = 0 then '/api/v1/' || event_type || '/' || md5(cast(event_id as varchar))
         else '/api/v1/' || event_type || '/list' end as path,
    case when event_id % 4 = 0 then ' 10.0.0.' || user_id || ', 10.1.1.1' when event_id % 4 = 1 then '' end as forwarded_for,
    '192.168.0.' || user_id as client, case when event_id % 5 > 0 then repeat(props, 60) else '' end as user_agent, ts as created_at
    from events"""
AUDIT_SQL = f"""select id, method || ' ' || path as action, nullif(split_part(path, '/', 4), '') as resource_type,
    case when regexp_matches(split_part(path, '/', 5), '^[0-9a-f]{{32}}$') then split_part(path, '/', 5) end as resource_id,
    case when coalesce(forwarded_for, '') <> '' then trim(split_part(forwarded_for, ',', 1)) else client end as ip_address,
    nullif(substr(user_agent, 1, 400), '') as agent from ({LOG_SQL})"""


def access_log(spark, folder):
    e, kind = table(spark, folder, "events"), F.col("event_type")
    i = F.col("event_id")
    prefix = F.lit("/api/v1/")
    return e.select(
        i.alias("id"),
        F.when(kind == "view", "GET").otherwise("POST").alias("method"),
        F.when(i % 11 == 0, prefix)
        .when(i % 3 == 0, F.concat(prefix, kind, F.lit("/"), F.md5(i.cast("string"))))
        .otherwise(F.concat(prefix, kind, F.lit("/list")))
        .alias("path"),
        F.when(i % 4 == 0, F.concat(F.lit(" 10.0.0."), "user_id", F.lit(", 10.1.1.1")))
        .when(i % 4 == 1, "")
        .alias("forwarded_for"),
        F.concat(F.lit("192.168.0."), "user_id").alias("client"),
        F.when(i % 5 > 0, F.repeat("props", F.lit(60))).otherwise("").alias("user_agent"),
        F.col("ts").alias("created_at"),
    )


@registered("registry_audit_entries", AUDIT_SQL)
def audit(spark, folder):
    entries = R.audit_entries(access_log(spark, folder))
    return entries.select("id", "action", "resource_type", "resource_id", "ip_address", "agent")


@registered(
    "registry_audit_search",
    f"""select a.id, a.action from ({AUDIT_SQL}) a join events on id = event_id
        where a.action ilike '%POST%click%' or a.resource_type ilike '%POST%click%' order by ts desc, id limit 20""",
)
def audit_search(spark, folder):
    entries = R.audit_entries(access_log(spark, folder))
    return R.audit_search(entries, "post%CLICK", R.PageParams()).select("id", "action")


SLUG_SQL = """with n as (select p_partkey, p_size as parent, replace(p_name, ' ', '-') as base,
            row_number() over (partition by p_size, p_name order by p_retailprice, hash_order) - 1 as k
          from (select *, cast('0x' || substr(md5(cast(p_partkey as varchar) || '|42'), 1, 15) as bigint) as hash_order from part)),
        t as (select distinct p_size as parent, replace(p_name, ' ', '-') as base,
                case when p_partkey % 3 = 0 then 1 else cast(p_partkey % 4 + 2 as int) end as taken
              from part where p_partkey % 2 = 0),
        f as (select parent, base, i, row_number() over (partition by parent, base order by i) - 1 as k
              from (select distinct parent, base from n) g cross join (select unnest(range(1, 100)) as i) r
              anti join t on t.parent = g.parent and t.base = g.base and t.taken = r.i)
        select p_partkey, n.parent, case when i = 1 then n.base else n.base || '-' || i end as slug
        from n join f on n.parent = f.parent and n.base = f.base and n.k = f.k"""


@registered("registry_unique_slugs", SLUG_SQL)
def slugs(spark, folder):
    return _slugs(table(spark, folder, "part"))


def _slugs(part):
    new = part.select("p_partkey", F.col("p_size").alias("parent"), "p_name", "p_retailprice")
    base = F.replace("p_name", F.lit(" "), F.lit("-"))
    existing = part.filter(F.col("p_partkey") % 2 == 0).select(
        F.col("p_size").alias("parent"),
        F.when(F.col("p_partkey") % 3 == 0, base)
        .otherwise(F.concat_ws("-", base, (F.col("p_partkey") % 4 + 2).cast("string")))
        .alias("slug"),
    )
    made = R.unique_slugs(new, existing, "parent", "p_name", "p_retailprice", ["p_partkey"])
    return made.select("p_partkey", "parent", "slug")


@registered(
    "registry_unique_slugs_missing_parent",
    f"""select p_partkey, nullif(parent, -1) as parent, slug from ({SLUG_SQL.replace("p_size", "(case when p_size % 5 > 0 then p_size else -1 end)")})""",
)
def slugs_missing_parent(spark, folder):
    """A NULL parent is a parent like any other."""
    part = table(spark, folder, "part").withColumn("p_size", F.expr("case when p_size % 5 > 0 then p_size end"))
    return _slugs(part)


@registered(
    "notifications_emitted",
    """with e as (select o_custkey as id, count(*) as n, count(*) filter (where o_orderstatus = 'O') as good from orders
                 group by 1 having count(*) filter (where o_orderstatus = 'P') = 0)
       select c_nationkey as user_id, c_custkey as subject_id,
         case when good > 0 then 'experiment_completed' else 'experiment_failed' end as kind,
         case when good > 0 then c_name || ': ' || good || ' of ' || n || ' runs completed'
              else c_name || ': all ' || n || ' runs failed' end as message
       from customer join e on c_custkey = e.id
       union all select c_nationkey, c_custkey, 'model_deployed', c_name || ' version ' || (c_custkey % 9) || ' is in production'
       from customer join events on user_id = c_custkey where event_type = 'purchase'""",
)
def notifications(spark, folder):
    """Ended experiments and deployed models tell their owners."""
    customer = table(spark, folder, "customer")
    owned = customer.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") % 9).alias("version"),
    )
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    runs = table(spark, folder, "orders").select(F.col("o_custkey").alias("experiment_id"), status.alias("status"))
    changes = table(spark, folder, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("model_id"), F.lit("production").alias("stage"), F.col("ts").alias("at")
    )
    both = R.ended_notifications(owned, runs, F.current_timestamp()).unionByName(R.deployed_notifications(owned, changes))
    return both.select("user_id", "subject_id", "kind", "message")
