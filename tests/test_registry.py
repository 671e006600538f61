import random

import pytest
from pyspark.sql import functions as F

from tablewright.errors import DataLoadError, RegistryError
from tablewright.plans import registry as R
from tablewright.sources import tables as S


def test_stages_equal_one_by_one_simulation(spark):
    rng = random.Random(1)
    models = [(i, i % 3, "s") for i in range(12)]
    changes = [(rng.randrange(12), rng.choice(R.STAGES), t) for t in range(60)]
    state = {i: "none" for i, _, _ in models}
    for model, stage, _ in changes:
        if stage == "production":
            for i, project, _ in models:
                if project == models[model][1] and i != model and state[i] == "production":
                    state[i] = "archived"
        state[model] = stage
    df = spark.createDataFrame(models, "id int, project_id int, slug string").withColumn("stage", F.lit("none"))
    found = R.model_stages(df, spark.createDataFrame(changes, "model_id int, stage string, at int"))
    assert {r["id"]: r["stage"] for r in found.collect()} == state


def test_slugs_equal_one_by_one_simulation(spark):
    rng = random.Random(2)
    existing = {(p, s) for p in (1, 2) for s in ("report", "report-2", "report-4", "data-3") if rng.random() < 0.8}
    new = [(i, rng.choice([1, 2]), rng.choice(["Report", "Data!", "other"]), i) for i in range(40)]
    taken, expected = set(existing), {}
    for i, parent, name, _ in new:
        base = name.lower().strip("!")
        candidate, k = base, 2
        while (parent, candidate) in taken:
            candidate, k = f"{base}-{k}", k + 1
        taken.add((parent, candidate))
        expected[i] = candidate
    made = R.unique_slugs(
        spark.createDataFrame(new, "id int, parent int, name string, at int"),
        spark.createDataFrame(sorted(existing), "parent int, slug string"),
        "parent", "name", "at", ["id"],
    )
    assert {r["id"]: r["slug"] for r in made.collect()} == expected


def test_numbers_follow_local_times(spark):
    """Times inside a clock change keep their order in any session time zone."""
    times = ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-03-10 03:10:00", "2024-03-10 03:40:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, t string").select(
        "id", F.col("t").cast("timestamp_ntz").alias("t"), F.lit(1).alias("g")
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = R.number_in_order(df, ["g"], "t", ["id"]).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["_number"] for r in rows] == [0, 1, 2, 3]
    dated = R.number_in_order(df.withColumn("t", F.date_add(F.col("t").cast("date"), F.col("id"))), ["g"], "t", ["id"])
    assert sorted((r["id"], r["_number"]) for r in dated.collect()) == [(i, i) for i in range(4)]


def test_current_state_and_soft_delete(spark):
    rows = [("a", 1, 1, None), ("a", 2, 2, None), ("b", 5, 1, None), ("b", 5, 3, "gone")]
    df = spark.createDataFrame(rows, "id string, v int, updated_at int, deleted_at string")
    state = R.current_state(df)
    assert sorted((r["id"], r["v"]) for r in state.collect()) == [("a", 2), ("b", 5)]
    assert [r["id"] for r in R.live(state).collect()] == ["a"]
    assert R.live(R.soft_deleted(R.live(state))).count() == 0


def test_versions(spark):
    models = spark.createDataFrame([(1, "m", 1), (1, "m", 2)], "project_id int, slug string, version int")
    assert R.next_version(models, project_id=1, slug="m") == 3
    assert R.next_version(models, project_id=1, slug="other") == 1


def test_paging(spark):
    df = spark.range(45).withColumn("created_at", F.col("id"))
    third = R.PageParams(page=3)
    assert [r["id"] for r in R.page_items(df, third).collect()] == [4, 3, 2, 1, 0]
    assert tuple(R.page_position(df, third).first()) == (3, 20, 45, 3, False, True)
    assert tuple(R.page_position(df.limit(0), R.PageParams()).first()) == (1, 20, 0, 0, False, False)
    with pytest.raises(RegistryError):
        R.page_items(df, R.PageParams(size=101))


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("kind", ["int", "string", "timestamp", "timestamp_ntz", "double"])
def test_pages_walk_through_every_row_once(spark, monkeypatch, descending, kind):
    """A column of many ties and nulls: all pages in turn are the sorted table, at every depth."""
    monkeypatch.setattr(R, "BRACKET_ROWS", 40)
    monkeypatch.setattr(R, "SAMPLED_ROWS", 60)
    value = F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 13)
    typed = {"timestamp": F.timestamp_seconds(value * 3600), "timestamp_ntz": F.timestamp_seconds(value).cast("timestamp_ntz")}
    df = spark.range(700).select("id", typed.get(kind, value.cast(kind)).alias("v")).repartition(6).cache()
    order = F.col("v").desc() if descending else F.col("v").asc()
    expected = [r.id for r in df.orderBy(order, "id").collect()]
    for page in (1, 2, 5, 7, 8):
        params = R.PageParams(page=page, size=100, sort_by="v", descending=descending)
        assert [r.id for r in R.page_items(df, params).collect()] == expected[(page - 1) * 100 : page * 100]


def test_pages_without_a_tiebreak_fit_together(spark, monkeypatch):
    monkeypatch.setattr(R, "BRACKET_ROWS", 40)
    monkeypatch.setattr(R, "SAMPLED_ROWS", 60)
    df = spark.range(300).select(F.col("id").alias("n"), (F.col("id") % 3).alias("created_at")).repartition(5).cache()
    found = [r.n for page in range(1, 8) for r in R.page_items(df, R.PageParams(page=page, size=50)).collect()]
    assert len(found) == 300 and sorted(found) == list(range(300))
    alike = spark.range(200).select(F.lit(1).alias("created_at"))
    assert R.page_items(alike, R.PageParams(page=2, size=100)).count() == 100


def test_row_store(spark, tmp_path):
    """Changes, deletes by id with a count, and snapshots: the state is the latest version of each row."""
    store = R.RowStore(spark, f"{tmp_path}/rows")
    with pytest.raises(RegistryError):
        store.state()
    schema = "id int, name string, updated_at int"
    store.append(spark.createDataFrame([(i, f"n{i}", 1) for i in range(6)], schema))
    store.append(spark.createDataFrame([(1, "new", 2), (7, "late", 2)], schema))
    assert store.delete(spark.createDataFrame([(0,), (7,), (7,), (99,)], "key int"), F.lit(3)) == 2
    assert store.delete(spark.createDataFrame([(0,)], "key int"), F.lit(4)) == 0
    state = {1: "new", **{i: f"n{i}" for i in range(2, 6)}}
    assert {r.id: r.name for r in store.state().collect()} == state
    assert store.compact() == 1
    assert {r.id: r.name for r in store.state().collect()} == state
    store.append(spark.createDataFrame([(2, "newer", 5), (8, "x", 5)], schema))
    assert {r.id: r.name for r in store.state().collect()} == state | {2: "newer", 8: "x"}
    upto, folders = store._upto()
    assert upto == 4 and len(folders) == 2  # the snapshot and one change
    assert store.compact() == 2 and len(store._upto()[1]) == 1


def test_two_writers_get_two_versions(spark, tmp_path):
    from multiprocessing.pool import ThreadPool

    store = S.VersionedTable(spark, f"{tmp_path}/t")
    frames = [spark.range(n).select("id") for n in range(1, 7)]
    with ThreadPool(6) as pool:
        numbers = pool.map(store.write, frames)
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6] == store.versions()
    rows = {r.version: r.n_rows for r in store.records().collect()}
    assert rows == {number: n for number, n in zip(numbers, range(1, 7), strict=True)}
    assert all(store.read(v).count() == n for v, n in rows.items())


def test_a_writer_that_fails_leaves_no_version(spark, tmp_path):
    store = S.VersionedTable(spark, f"{tmp_path}/t")
    store.write(spark.range(3))
    with pytest.raises(Exception, match="stop"):
        store.write(spark.range(5).select(F.raise_error(F.lit("stop")).alias("x")))
    assert store.versions() == [1] and store.records().count() == 1
    assert store.write(spark.range(4)) == 2


def test_compare_needs_two_models(spark):
    with pytest.raises(RegistryError):
        R.compare_models(spark.range(1), [1])


def test_notifications(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", 5), (3, "v", None)], "id int, user_id string, read_at int")
    marked = R.marked_read(df, "u", F.lit(9)).orderBy("id").collect()
    assert [(r["read_at"], r["changed"]) for r in marked] == [(9, True), (5, False), (None, False)]
    assert [r["read_at"] for r in R.mark_one_read(df, 2, F.lit(9)).orderBy("id").collect()] == [None, 5, None]


@pytest.mark.parametrize(
    "name,kind", [("a.CSV", "csv"), ("a.txt", "csv"), ("b.XLSX", "excel"), ("c.xls", "excel"), ("d.parquet", "parquet")]
)
def test_file_types(name, kind):
    assert S.detect_file_type(name) == kind


def test_bad_files(spark, tmp_path):
    with pytest.raises(DataLoadError):
        S.detect_file_type("a.pdf")
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(DataLoadError):
        S.read_table(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(DataLoadError):
        S.read_table(spark, str(tmp_path / "absent.parquet"))
    with pytest.raises(DataLoadError):
        S.read_excel(spark, str(tmp_path), "a int")


def test_csv_types(spark, tmp_path):
    (tmp_path / "c.csv").write_text("age,income,gender,day\n25,1.5,M,2024-01-02\n,2.5,F,2024-01-03\n")
    df = S.read_table(spark, str(tmp_path / "c.csv"))
    assert dict(df.dtypes) == {"age": "int", "income": "double", "gender": "string", "day": "string"}


def test_versioned_table(spark, tmp_path):
    store = S.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(DataLoadError):
        store.read()
    assert store.write(spark.range(3)) == 1 and store.write(spark.range(5)) == 2
    assert store.read().count() == 5 and store.read(1).count() == 3
    first = store.describe(1).first()
    assert (first["version"], first["n_rows"], first["n_columns"]) == (1, 3, 1)
    mixed = S.content_checksum(spark.range(3).orderBy(F.desc("id")).repartition(3)).first()
    assert mixed["checksum"] == first["checksum"]


def test_page_walk_equals_page_after_page(spark):
    rows = [(i, "FOP"[i % 3] if i % 7 else None, None if i % 5 else i) for i in range(230)]
    df = spark.createDataFrame(rows, "`row key` int, status string, at int").repartition(6)
    for sort_by, descending in (("status", True), ("at", False), (None, True)):
        params = R.PageParams(page=2, size=20, sort_by=sort_by, descending=descending)
        walked = R.page_items(df, params, through=99).collect()
        assert len(walked) == 210
        for page in range(2, 13):
            one = R.page_items(df, R.PageParams(page=page, size=20, sort_by=sort_by, descending=descending)).collect()
            assert {r[:3] for r in walked if r.page == page} == {tuple(r) for r in one}
    assert R.page_items(df.limit(0), R.PageParams(size=20), through=1).count() == 0
