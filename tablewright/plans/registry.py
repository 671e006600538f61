"""Relational operators on the metadata tables: datasets, runs, models, notifications, audit.

Tables are append-only: a change appends a new version of a row, and the current state is the
latest version per id. "Latest" is a ``max_by`` aggregate, which combines on the map side, so
one id with a very long history is no hot task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.errors import RegistryError
from tablewright.functions.scalars import quoted, slugify
from tablewright.operators.ordering import hash_numbered, null_safe_join, running_totals
from tablewright.session import cut_lineage
from tablewright.sources.tables import NumberedFolders

# Enumerations, page limits and the metrics of a comparison.
RUN_STATES = ("pending", "running", "completed", "failed")
EXPERIMENT_STATES = ("draft", "queued", "running", "completed", "failed", "cancelled")
STAGES = ("none", "staging", "production", "archived")
NOTIFICATION_TYPES = ("info", "success", "warning", "error")
PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
COMPARED_MODELS = (2, 10)
USER_AGENT_LENGTH = 400
API_PREFIX = "/api/v1/"
COMPARED_METRICS = ("accuracy", "f1_weighted", "roc_auc", "r2", "rmse", "mae")
SEARCHED = {
    "projects": ("name", "slug", "description"),
    "datasets": ("name", "slug", "description"),
    "experiments": ("name", "description"),
    "models": ("name", "slug", "algorithm", "description"),
    "notifications": ("title", "message"),
    "audit": ("action", "path", "resource_type"),
    "users": ("email", "full_name"),
}
UUID_DECORATION = "urn:|uuid:|[{}-]"
UUID_DIGITS = "^[0-9a-fA-F]{32}$"


# Reading -------------------------------------------------------------------------------------


def equal_to(df: DataFrame, **filters) -> DataFrame:
    """Rows equal to all filters; an unknown column or a None value is no condition."""
    for name, value in filters.items():
        if name in df.columns and value is not None:
            df = df.filter(quoted(name) == value)
    return df


def find(df: DataFrame, **filters) -> DataFrame:
    """At most one matching row."""
    return equal_to(df, **filters).limit(1)


def exists(df: DataFrame, **filters) -> bool:
    """Whether any row matches; stops at the first one."""
    return not equal_to(df, **filters).isEmpty()


def count(df: DataFrame, **filters) -> int:
    """Number of matching rows."""
    return equal_to(df, **filters).count()


def search(df: DataFrame, term: str | None, columns: list[str]) -> DataFrame:
    """Rows where any column contains the term, ignoring case; ``%`` and ``_`` are wildcards."""
    known = [c for c in columns if c in df.columns]
    if not term or not known:
        return df
    hits = [quoted(c).ilike(f"%{term}%") for c in known]
    return df.filter(reduce(lambda a, b: a | b, hits))


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())


def owned_by(df: DataFrame, user: str, superuser: bool = False) -> DataFrame:
    """The owner's rows; every row for a superuser."""
    return df if superuser else df.filter(F.col("owner_id") == user)


@dataclass(frozen=True)
class PageParams:
    """One page of a sorted list."""

    page: int = 1
    size: int = PAGE_SIZE
    sort_by: str | None = None
    descending: bool = True

    def validate(self) -> None:
        if self.page < 1 or not 1 <= self.size <= MAX_PAGE_SIZE:
            raise RegistryError(f"page must be 1 or more, size 1 to {MAX_PAGE_SIZE}.")


def _sort_keys(df: DataFrame, params: PageParams, tiebreak: str) -> list[tuple[Column, bool]]:
    """Columns of a total order and whether they fall: the one asked for (else ``created_at``, if there
    is one), then ``tiebreak``; a table without that is ordered by a hash of the row."""
    name = params.sort_by if params.sort_by in df.columns else "created_at"
    keys = [(_comparable(df, name), params.descending)] if name in df.columns else []
    if tiebreak in df.columns:
        return [*keys, (_comparable(df, tiebreak), False)]
    return [*keys, (F.xxhash64(*[quoted(c) for c in df.columns]), False)]


def _comparable(df: DataFrame, name: str) -> Column:
    """A column in a form of the same order whose values compare alike here and on the driver."""
    kind = df.schema[name].dataType.typeName()
    return F.unix_micros(quoted(name)) if kind == "timestamp" else quoted(name).cast("string") if kind == "timestamp_ntz" else quoted(name)


def ordered(df: DataFrame, params: PageParams, tiebreak: str = "id") -> DataFrame:
    """Sorted by the requested column, else by ``created_at``; ties by ``tiebreak`` or a row hash."""
    return df.orderBy(*[k.desc() if falls else k.asc() for k, falls in _sort_keys(df, params, tiebreak)])


def page_items(df: DataFrame, params: PageParams, tiebreak: str = "id", through: int | None = None) -> DataFrame:
    """The rows of one page, in the order of :func:`ordered`.

    Order statistics find the page at every depth alike: a sample of the rows, by hash, gives bounds
    around it, one pass counts the rows before and inside them, and this goes on inside until few
    rows are left, which are sorted. Nothing else is sorted, and no task holds more than a sample.

    With ``through`` the rows of all pages up to that one, each with its ``page``, from one sort.
    """
    params.validate()
    if through is not None:
        return _page_walk(df, params, through, tiebreak)
    keys = _sort_keys(df, params, tiebreak)
    offset = (params.page - 1) * params.size
    inside, before, n, margin = df, 0, df.count(), 4.0
    while n > BRACKET_ROWS:
        low, high = _bracket(inside, keys, (offset - before) / n, (offset - before + params.size) / n, margin)
        if low is None and high is None:
            break  # rows are alike in all keys, or the page is as wide as the table
        first, last = F.lit(False), F.lit(True)
        if low is not None:
            first = _precedes(keys, low)
        if high is not None:
            last = ~_follows(keys, high)
        counts = inside.agg(F.count_if(first).alias("first"), F.count_if(~first & last).alias("held")).first()
        covered = before + counts["first"] <= offset and before + counts["first"] + counts["held"] >= min(offset + params.size, before + n)
        if not covered or counts["held"] >= n:
            margin *= 4  # the bounds missed the page
            continue
        inside, before, n = inside.filter(~first & last), before + counts["first"], counts["held"]
    return ordered(inside, params, tiebreak).offset(offset - before).limit(params.size)


def _page_walk(df: DataFrame, params: PageParams, last: int, tiebreak: str) -> DataFrame:
    """The rows of the pages from ``params.page`` to ``last``, each with its ``page``: what
    :func:`page_items` gives for one after another, from one distributed sort. The numbers of rows in
    the parts of the order become offsets, so no task holds more than a part."""
    placed = cut_lineage(ordered(df, params, tiebreak).select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row a part
    starts = F.broadcast(counts.select("part", before.alias("start")))
    number = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    paged = placed.withColumn("part", part).join(starts, "part").select("row", (F.floor(number / params.size) + 1).cast("bigint").alias("page"))
    return paged.filter(F.col("page").between(params.page, last)).select("row.*", "page")


#: Rows that are sorted at once, and rows of a sample.
BRACKET_ROWS = 100_000
SAMPLED_ROWS = 4_000


def _bracket(df: DataFrame, keys: list[tuple[Column, bool]], low: float, high: float, margin: float) -> tuple:
    """Rows of a sample that lie before and after the shares ``low`` and ``high`` of the order, with a
    margin that a sample rarely misses; None beyond its ends, and both None if they are alike."""
    order = F.xxhash64(*[quoted(c) for c in df.columns], F.lit(7))
    sample = df.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)], order.alias("h"))
    sample = sample.orderBy("h").limit(SAMPLED_ROWS)
    named = [F.col(f"k{i}").desc() if falls else F.col(f"k{i}").asc() for i, (_, falls) in enumerate(keys)]
    rows = sample.orderBy(*named).drop("h").collect()
    if not rows or rows[0] == rows[-1]:
        return None, None
    margin *= math.sqrt(len(rows)) / 2
    first, last = int(low * len(rows) - margin), int(math.ceil(high * len(rows) + margin))
    return rows[first] if first > 0 else None, rows[last] if last < len(rows) else None


def _precedes(keys: list[tuple[Column, bool]], row) -> Column:
    """Whether a row comes before another in the order; NULL is the lowest value."""
    found, alike = F.lit(False), F.lit(True)
    for (key, falls), value in zip(keys, row, strict=True):
        if value is None:
            less, equal = (key.isNotNull() if falls else F.lit(False)), key.isNull()
        else:
            bound = F.lit(value)
            less = F.coalesce(key > bound if falls else key < bound, F.lit(not falls))
            equal = key.eqNullSafe(bound)
        found, alike = found | (alike & less), alike & equal
    return found


def _follows(keys: list[tuple[Column, bool]], row) -> Column:
    """Whether a row comes after another in the order."""
    same = F.lit(True)
    for (key, _), value in zip(keys, row, strict=True):
        same = same & (key.isNull() if value is None else key.eqNullSafe(F.lit(value)))
    return ~_precedes(keys, row) & ~same


def page_position(df: DataFrame, params: PageParams) -> DataFrame:
    """One row that tells where a page stands among the matching rows: page, size, total, pages,
    has_next, has_prev. Nothing is counted before the row is asked for."""
    params.validate()
    pages = F.ceil(F.col("total") / params.size)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(params.page).alias("page"), F.lit(params.size).alias("size"), "total", pages.alias("pages"),
        (pages > params.page).alias("has_next"), F.lit(params.page > 1).alias("has_prev"),
    )


def with_parent(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id",
                prefix: str = "parent_") -> DataFrame:
    """Children with their parent's columns (prefixed); children without one are kept."""
    renamed = parent.select(*[quoted(c).alias(prefix + c) for c in parent.columns])
    return child.join(renamed, quoted(key) == quoted(prefix + parent_key), "left")


def with_children(parent: DataFrame, child: DataFrame, key: str, order: list[Column],
                  parent_key: str = "id", prefix: str = "child_") -> DataFrame:
    """Parents with their children as flat rows in order; a parent without one is kept.

    The rows stay flat, so a parent with very many children is not packed into one value; the
    sort is a range-partitioned one over (parent, order).
    """
    renamed = child.select("*").toDF(*[prefix + c for c in child.columns])
    joined = parent.join(renamed, quoted(parent_key) == quoted(prefix + key), "left")
    return joined.orderBy(quoted(parent_key), *order)


# Writing -------------------------------------------------------------------------------------


def current_state(versions: DataFrame, key: str = "id", at: list[str] | None = None) -> DataFrame:
    """The latest version of every row of an append-only table; removed rows are left out."""
    at = at or ["updated_at"]
    latest = versions.groupBy(quoted(key)).agg(
        F.max_by(
            F.struct(*[quoted(c) for c in versions.columns if c != key]),
            F.struct(*[quoted(c) for c in at]),
        ).alias("_row")
    )
    state = latest.select(quoted(key), "_row.*").select(*[quoted(c) for c in versions.columns])
    return state.filter(~F.col("removed")).drop("removed") if "removed" in state.columns else state


class RowStore:
    """A table of row versions in folders: ``change=N`` holds appended versions, ``snapshot=N`` the state
    after the changes up to N, removed rows left out.

    A read takes the latest snapshot and the changes after it. Every folder becomes visible whole
    (see ``NumberedFolders``); a snapshot replaces nothing, so readers of an older one go on.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", at: list[str] | None = None):
        self.spark, self.key, self.at = spark, key, at or ["updated_at"]
        self.changes = NumberedFolders(spark, path, "change")
        self.snapshots = NumberedFolders(spark, path, "snapshot")

    def append(self, rows: DataFrame) -> int:
        """Add row versions; ``removed`` marks rows that are gone (missing: none is)."""
        if "removed" not in rows.columns:
            rows = rows.withColumn("removed", F.lit(False))
        return self.changes.add(lambda folder: rows.write.parquet(f"{folder}/rows"))

    def _upto(self) -> tuple[int, list[str]]:
        """The last change, and the folders that hold the state."""
        made = {int(n): folder for folder in map(self.snapshots.folder, self.snapshots.numbers()) for n in [self._mark(folder)]}
        done = max(made, default=0)
        later = [n for n in self.changes.numbers() if n > done]
        folders = [f"{made[done]}/rows"] if made else []
        return max([done, *later]), folders + [f"{self.changes.folder(n)}/rows" for n in later]

    def _mark(self, folder: str) -> int:
        """The last change that a snapshot holds: the name of its only other folder."""
        names = self.snapshots._listed(folder)
        return next(int(n.removeprefix("upto=")) for n in names if n.startswith("upto="))

    def state(self) -> DataFrame:
        """The current rows."""
        folders = self._upto()[1]
        if not folders:
            raise RegistryError("The table has no rows yet.")
        return current_state(self.spark.read.parquet(*folders), self.key, self.at)

    def delete(self, ids: DataFrame, now: Column) -> int:
        """Remove the rows whose key is in the only column of ``ids``; return how many there were."""
        wanted = ids.select(F.col(ids.columns[0]).alias(self.key)).distinct()
        gone = cut_lineage(self.state().join(wanted, self.key, "left_semi").select("*"))
        n = gone.count()
        if n:
            stamped = gone.withColumn(self.at[0], now.cast(gone.schema[self.at[0]].dataType))
            self.append(stamped.withColumn("removed", F.lit(True)))
        return n

    def compact(self) -> int:
        """Fold the changes into a snapshot and return its number."""
        upto, _ = self._upto()
        state = self.state().withColumn("removed", F.lit(False))

        def write(folder: str) -> None:
            state.write.parquet(f"{folder}/rows")
            path, files = self.snapshots._hadoop(f"{folder}/upto={upto}")
            files.mkdirs(path)

        return self.snapshots.add(write)


def append(rows: DataFrame, path: str) -> None:
    """Append row versions to a table."""
    rows.write.mode("append").parquet(path)


def soft_deleted(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """New row versions that mark the rows as deleted."""
    now = F.current_timestamp() if now is None else now
    return rows.withColumn("deleted_at", now).withColumn("updated_at", now)


def marked_read(notifications: DataFrame, user: str, now: Column) -> DataFrame:
    """All notifications, the user's unread ones now read; ``changed`` tells which."""
    hit = (F.col("user_id") == user) & F.col("read_at").isNull()
    return notifications.withColumn("changed", hit).withColumn(
        "read_at", F.when(hit, now).otherwise(F.col("read_at"))
    )


def mark_one_read(notifications: DataFrame, notification: str, now: Column) -> DataFrame:
    """All notifications, the given one now read (unchanged if it already was)."""
    hit = (F.col("id") == notification) & F.col("read_at").isNull()
    return notifications.withColumn("read_at", F.when(hit, now).otherwise(F.col("read_at")))


def unread(notifications: DataFrame, user: str) -> DataFrame:
    """The user's unread notifications; page them afterwards."""
    return notifications.filter((F.col("user_id") == user) & F.col("read_at").isNull())


def unread_counts(notifications: DataFrame) -> DataFrame:
    """``(user_id, unread)`` for every user."""
    return notifications.groupBy("user_id").agg(
        F.count_if(F.col("read_at").isNull()).alias("unread")
    )


def ended_notifications(experiments: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """A notification to the owner of each experiment ``(id, owner_id, name)`` whose runs
    ``(experiment_id, status)`` have all ended: with a completed run, or failed altogether."""
    open_states = F.count_if(~F.col("status").isin("completed", "failed"))
    done = runs.groupBy(F.col("experiment_id").alias("id")).agg(
        open_states.alias("_open"), F.count_if(F.col("status") == "completed").alias("_good"),
        F.count(F.lit(1)).alias("_all"),
    )
    good = F.col("_good") > 0
    return experiments.join(done.filter("_open = 0"), "id").select(
        F.col("owner_id").alias("user_id"), F.col("id").alias("subject_id"),
        F.when(good, "experiment_completed").otherwise("experiment_failed").alias("kind"),
        F.when(good, F.format_string("%s: %d of %d runs completed", "name", "_good", "_all"))
        .otherwise(F.format_string("%s: all %d runs failed", "name", "_all")).alias("message"),
        now.alias("created_at"), F.lit(None).cast("timestamp").alias("read_at"),
    )


def deployed_notifications(models: DataFrame, changes: DataFrame) -> DataFrame:
    """A notification to the owner of each model ``(id, owner_id, name, version)`` for every change
    ``(model_id, stage, at)`` to production."""
    deployed = changes.filter(F.col("stage") == "production").select(F.col("model_id").alias("id"), "at")
    return models.join(deployed, "id").select(
        F.col("owner_id").alias("user_id"), F.col("id").alias("subject_id"), F.lit("model_deployed").alias("kind"),
        F.format_string("%s version %d is in production", "name", "version").alias("message"),
        F.col("at").alias("created_at"), F.lit(None).cast("timestamp").alias("read_at"),
    )


# Models --------------------------------------------------------------------------------------


def next_versions(models: DataFrame, group: list[str], version: str = "version") -> DataFrame:
    """The next version number per group, deleted rows counted."""
    return models.groupBy(*group).agg((F.max(version) + 1).alias("next_version"))


def next_version(models: DataFrame, version: str = "version", **group) -> int:
    """The next version number of one group; 1 for a new one."""
    top = equal_to(models, **group).agg(F.max(version).alias("v")).first()["v"]
    return (top or 0) + 1


def register_models(requests: DataFrame, runs: DataFrame, experiments: DataFrame,
                    models: DataFrame) -> DataFrame:
    """Model rows for requests ``(run_id, name, requested_at)``.

    Only completed runs with an artifact qualify. Versions go on per (project, slug) in the
    order of the requests, after the highest version that exists, deleted rows included.
    """
    usable = runs.filter((F.col("status") == "completed") & F.col("artifact").isNotNull())
    about = ["project_id", "task", "target_column", "primary_metric"]  # as the experiment says
    own = experiments.select(F.col("id").alias("experiment_id"), *about)
    asked = (
        requests.join(usable.withColumnRenamed("id", "run_id").drop(*about), "run_id")
        .join(own, "experiment_id")
        .withColumn("slug", slugify(F.col("name")))
        .withColumn("stage", F.lit("none"))
    )
    group = ["project_id", "slug"]
    numbered = number_in_order(asked, group, "requested_at", ["run_id"])
    tops = models.groupBy(*group).agg(F.max("version").alias("_top"))
    return null_safe_join(numbered, tops, group, "left").select(
        *[quoted(c) for c in asked.columns],
        (F.coalesce("_top", F.lit(0)) + F.col("_number") + 1).alias("version"),
    )


class Registered(NamedTuple):
    """What registering with deployment appends: ``models``, stage ``changes`` of older models, and
    ``notifications``."""

    models: DataFrame
    changes: DataFrame
    notifications: DataFrame


def register_and_deploy(requests: DataFrame, runs: DataFrame, experiments: DataFrame, models: DataFrame) -> Registered:
    """:func:`register_models` for requests that also say ``deploy`` and ``user_id``.

    Of the versions that one (project, slug) is asked to deploy the last one serves in production; the
    others were, and are archived, as is the model ``(id, project_id, slug, stage)`` that served before.
    Every deployment is notified to the user who asked for it.
    """
    group = ["project_id", "slug"]
    made = cut_lineage(register_models(requests, runs, experiments, models))
    asked = made.filter(F.coalesce("deploy", F.lit(False)))
    serving = cut_lineage(asked.groupBy(*group).agg(
        F.max("version").alias("_serving"), F.min_by("requested_at", "version").alias("_at")
    ))
    joined = null_safe_join(made, serving, group, "left")
    deployed = F.coalesce("deploy", F.lit(False))
    stage = F.when(deployed & (F.col("version") == F.col("_serving")), "production").when(deployed, "archived").otherwise("none")
    rows = joined.select(*[stage.alias("stage") if c == "stage" else quoted(c) for c in made.columns])
    older = null_safe_join(models.filter(F.col("stage") == "production"), serving, group)
    changes = older.select(F.col("id").alias("model_id"), F.lit("archived").alias("stage"), F.col("_at").alias("at"))
    notifications = asked.select(
        "user_id", F.col("run_id").alias("subject_id"), F.lit("model_deployed").alias("kind"),
        F.format_string("%s version %d is in production", "name", "version").alias("message"),
        F.col("requested_at").alias("created_at"), F.lit(None).cast("timestamp").alias("read_at"),
    )
    return Registered(rows, changes, notifications)


def model_stages(models: DataFrame, changes: DataFrame) -> DataFrame:
    """Models with the stage that follows from their stored one and all stage changes
    ``(model_id, stage, at)``.

    A model without changes keeps its stored stage, unless another of its (project, slug) was
    deployed since: deploying archives the one in production. So a model whose last own change,
    or stored stage, is ``production`` is in production only while no other model of the group
    was deployed later; any other last change stands. Of changes at one time the later stage, and
    then the larger id, counts. Grouped ``max_by`` aggregates are enough.
    """
    # stages travel as numbers: fixed-width values aggregate by hashing, texts by sorting
    stages = F.array(*[F.lit(name) for name in STAGES])
    coded = changes.select("model_id", "at", F.array_position(stages, F.col("stage")).alias("_s"))
    serving = STAGES.index("production") + 1
    last = coded.groupBy(F.col("model_id").alias("id")).agg(
        F.max_by("_s", F.struct("at", "_s")).alias("_last")
    )
    group = ["project_id", "slug"]
    own = models.select(F.col("id").alias("model_id"), *group)
    deployed = (
        coded.filter(F.col("_s") == serving)
        .join(own, "model_id")
        .groupBy(*group)
        .agg(F.max_by("model_id", F.struct("at", "model_id")).alias("_serving"))
    )
    stored = models.withColumnRenamed("stage", "_stored")
    joined = null_safe_join(stored.join(last, "id", "left"), deployed, group, "left")
    now = F.coalesce(F.get(stages, (F.col("_last") - 1).cast("int")), F.col("_stored"), F.lit("none"))
    replaced = (now == "production") & (F.col("_serving") != F.col("id"))
    stage = F.when(replaced, "archived").otherwise(now)
    columns = [stage.alias("stage") if c == "stage" else quoted(c) for c in models.columns]
    return joined.select(*columns)


def compare_models(
    models: DataFrame, ids: list, metrics: tuple[str, ...] = COMPARED_METRICS
) -> DataFrame:
    """Two to ten live models side by side: one row per metric, one column per model. Ids of
    deleted or unknown models are refused."""
    low, high = COMPARED_MODELS
    if not low <= len(ids) <= high:
        raise RegistryError(f"Compare {low} to {high} models.")
    chosen = (live(models) if "deleted_at" in models.columns else models).filter(F.col("id").isin(ids))
    missing = set(ids) - {r["id"] for r in chosen.select("id").distinct().collect()}  # ten at most
    if missing:
        raise RegistryError(f"No live model has the id {sorted(missing)[0]!r}.")
    rows = chosen.select(
        "id", F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.try_element_at("metrics", F.lit(m)).alias("value"))
            for m in metrics
        ])).alias("m")
    ).select("id", "m.*")
    return rows.groupBy("metric").pivot("id", ids).agg(F.first("value"))


# Audit ---------------------------------------------------------------------------------------


def audit_entries(requests: DataFrame) -> DataFrame:
    """Access-log rows ``(method, path, forwarded_for, client, user_agent, …)`` with the action,
    the resource type, a UUID-like resource id, the client address and a bounded user agent."""
    rest = F.substr("path", F.lit(len(API_PREFIX) + 1))
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    second = F.get(parts, F.lit(1))
    forwarded = F.trim(F.get(F.split("forwarded_for", ","), F.lit(0)))
    agent = F.substring("user_agent", 1, USER_AGENT_LENGTH)
    return requests.select(
        "*",
        F.concat_ws(" ", "method", "path").alias("action"),
        F.get(parts, F.lit(0)).alias("resource_type"),
        F.when(F.regexp_replace(second, UUID_DECORATION, "").rlike(UUID_DIGITS), second).alias(
            "resource_id"
        ),
        F.when(F.coalesce("forwarded_for", F.lit("")) != "", forwarded)
        .otherwise(F.col("client"))
        .alias("ip_address"),
        F.when(agent != "", agent).alias("agent"),
    )


def audit_search(entries: DataFrame, term: str | None, params: PageParams) -> DataFrame:
    """One page of audit entries, newest first, searched by action, path and resource type."""
    return page_items(search(entries, term, list(SEARCHED["audit"])), params)


# Names ---------------------------------------------------------------------------------------


def _as_number(df: DataFrame, name: str) -> Column:
    """A number, date or timestamp as a double that keeps the order (exact to microseconds)."""
    kind, value = df.schema[name].dataType.typeName(), quoted(name)
    if kind == "date":
        value = F.unix_date(value)
    elif kind == "timestamp":
        value = F.unix_micros(value)
    elif kind == "timestamp_ntz":  # read as UTC: a local zone's clock changes would reorder
        value = F.unix_micros(F.concat(value.cast("string"), F.lit("Z")).cast("timestamp"))
    return value.cast("double")


def number_in_order(df: DataFrame, group: list[str], order: str, key: list[str]) -> DataFrame:
    """Number the rows of each group 0, 1, … by the timestamp or number ``order``.

    Equal order values are packed first, running totals place them, and rows with one value are
    told apart by a hash of their key: no task ever sorts a whole group. A NULL order comes last;
    NULL in ``group`` is a group like any other.
    """
    placed = df.withColumn("_at", F.coalesce(_as_number(df, order), F.lit(float("nan"))))
    packed = placed.groupBy(*group, "_at").agg(F.count("*").alias("_n"))
    totals = running_totals(packed, order="_at", sums=["_n"], by=group).select(
        *group, "_at", (F.col("cum__n") - F.col("_n")).alias("_before")
    )
    inside = hash_numbered(
        placed, by=[*[quoted(c) for c in group], F.col("_at")], key=key,
        number="_inside", total="_same",
    )
    return null_safe_join(inside, totals, [*group, "_at"]).select(
        *[quoted(c) for c in df.columns], (F.col("_before") + F.col("_inside")).alias("_number")
    )


def unique_slugs(new: DataFrame, existing: DataFrame, parent: str, name: str, order: str,
                 key: list[str]) -> DataFrame:
    """Slugs for new rows, unique per parent: ``base``, ``base-2``, ``base-3``, …

    ``existing`` has ``(parent, slug)``, deleted rows included. In each (parent, base) the rows
    take the free numbers in their order. Taken are the existing slugs, and literal names in the
    batch that look like a numbered slug (``report-2``) keep their own.
    """
    based = new.withColumn("_base", slugify(quoted(name)))
    numbered = cut_lineage(number_in_order(based, [parent, "_base"], order, key))
    claimed = existing.select(quoted(parent), F.col("slug").alias("_slug")).unionByName(
        based.select(quoted(parent), F.col("_base").alias("_slug")), True
    )
    stem = F.regexp_extract("_slug", "^(.+)-([0-9]{1,9})$", 1)
    digits = F.regexp_extract("_slug", "^(.+)-([0-9]{1,9})$", 2)
    number = F.when(digits != "", digits.try_cast("bigint"))
    as_number = claimed.select(quoted(parent), stem.alias("_base"), number.alias("_t")).filter(
        (F.col("_t") >= 2) & (F.concat_ws("-", stem, F.col("_t").cast("string")) == F.col("_slug"))
    )
    as_base = existing.select(
        quoted(parent), F.col("slug").alias("_base"), F.lit(1).cast("bigint").alias("_t")
    )
    groups = numbered.select(parent, "_base").distinct()
    taken = (
        null_safe_join(as_number.unionByName(as_base).distinct(), groups, [parent, "_base"], "left_semi")
        .withColumn("_at", F.col("_t").cast("double"))
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    by = [parent, "_base"]
    ranked = running_totals(cut_lineage(taken), order="_at", sums=["_one"], by=by)
    # free numbers below a taken one; row n comes after the taken ones with at most n below
    gaps = (
        ranked.select(*by, (F.col("_t") - F.col("cum__one")).cast("double").alias("_at"))
        .groupBy(*by, "_at")
        .agg(F.count("*").alias("_w"))
    )
    marks = numbered.select(
        *by, (F.col("_number") + 0.5).alias("_at"), F.lit(0).cast("bigint").alias("_w")
    )
    placed = running_totals(gaps.unionByName(marks), order="_at", sums=["_w"], by=by).filter(
        F.col("_at") != F.floor("_at")
    )
    suffix = F.col("_number") + 1 + F.col("cum__w")
    joined = null_safe_join(
        numbered.withColumn("_at", F.col("_number") + 0.5), placed.select(*by, "_at", "cum__w"), [*by, "_at"]
    )
    return joined.select(
        *[quoted(c) for c in new.columns],
        F.when(suffix == 1, F.col("_base"))
        .otherwise(F.concat_ws("-", "_base", suffix.cast("string")))
        .alias("slug"),
    )
