from datetime import datetime

from conftest import rows

from loomline.operators import orphans as O

T = lambda d: datetime(2024, 1, d)
FILES = "id string, run_id string, repository_id string, created_at timestamp_ntz, ref string"
SMALL = "id string, project_id string, created_at timestamp_ntz"


def tables(spark, files, repositories=(), runs=(), projects=()):
    make = lambda data, schema: spark.createDataFrame(list(data), schema)
    return {"files": make(files, FILES), "repositories": make(repositories, SMALL), "runs": make(runs, SMALL), "projects": make([(p, None, T(1)) for p in projects], SMALL)}


def deleted(spark, *data):
    return spark.createDataFrame(list(data), "table_name string, record_id string, deleted_at timestamp_ntz")


def test_states_and_spellings(spark):
    runs = [("run-a", "p1", T(5)), ("run-a", "p1", T(5)), ("run-b", "gone", T(2)), ("back", " P1 ", T(1))]
    files = [
        ("f1", "{RUN-A}", None, T(6), "x"), ("f2", "run-a ", "", T(4), "x"), ("f3", "run-x", "\t", T(4), "x"), ("f3", "run-x", "\t", T(4), "x"), ("f4", "run-d", "rep", None, "x"), ("f5", "back", "n/a", T(1), "x"),
        ("f6", None, None, None, "x"), ("f7", "run-a", None, None, "x"), ("f8", "--", None, T(1), "x"), (None, "run-y", None, T(1), "x"),
    ]
    t = tables(spark, files, repositories=[("Rep", None, T(1))], runs=runs, projects=["P1"])
    d = deleted(spark, ("Runs", "RUN-D", T(3)), ("runs", "back", T(3)), ("projects", "gone", T(3)), (None, None, None))
    want = [
        ("files", "run_id", "f2", "late"), ("files", "run_id", "f3", "missing"), ("files", "run_id", "f4", "deleted"), ("files", "repository_id", "f5", "missing"), ("files", "run_id", "f8", "missing"),
        ("files", "run_id", None, "missing"), ("runs", "project_id", "run-b", "deleted"),
    ]
    assert rows(O.found(t, d)) == sorted(want, key=repr)
    counts = {(r[0], r[1], r[2], r[3]): r[4] for r in O.counts(t, d).collect()}
    assert counts["files", "run_id", "2024-01", "missing"] == 3 and counts["files", "run_id", None, "deleted"] == 1


def test_hot_key_and_heavy_split(spark):
    files = [(f"f{i}", "hot" if i % 3 else f"cold{i}", None, T(1 + i % 28), "x") for i in range(600)]
    t = tables(spark, files)
    every = {share: rows(O.orphans(t, deleted(spark), share).select("row_id", "state")) for share in (0.0, 0.001, 0.5, 1.0)}
    assert all(len(v) == 600 and v == every[0.0] for v in every.values())


def test_rows_of_heavy_keys_are_never_shuffled(spark, monkeypatch):
    """With tables too large to broadcast, a key named by a third of all rows leaves by a broadcast before the shuffled join."""
    monkeypatch.setattr(O.store, "checked_broadcast", lambda df, *a, **k: df)
    files = [(f"f{i}", "hot" if i % 3 == 0 else f"cold{i}", None, T(1 + i % 28), "x") for i in range(300)]
    t = tables(spark, files, runs=[("hot", None, T(1))])
    got = O.orphans(t, deleted(spark), 0.1)
    assert rows(got.select("row_id"))[:2] == [("f1",), ("f10",)] and got.count() == 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
    anti = [i for i, line in enumerate(plan.splitlines()) if "LeftAnti" in line]
    assert anti and "broadcast" in plan


def test_empty_tables(spark):
    assert rows(O.found(tables(spark, []), deleted(spark))) == []
    assert rows(O.counts(tables(spark, []), deleted(spark))) == []
