import json
from datetime import date, datetime

import pytest
from conftest import rows

from loomline.operators import history as H
from loomline.sources import keyed

SCHEMA = "id bigint, as_of_date date, payload string, loaded_at timestamp_ntz"


def snap(i, day, body, loaded=None):
    return (i, day and date(2024, 1, day), body if body is None or isinstance(body, str) else json.dumps(body), datetime(2024, 1, loaded or day or 1, 12))


def found(spark, data):
    return rows(H.versions(H.build(spark.createDataFrame(data, SCHEMA))))


def test_versions_of_dirty_snapshots(spark):
    data = [
        snap(1, 1, {"isin": "x a1", "ticker": "AB", "region": "EMEA"}),
        snap(2, 2, {"ISIN": "XA1", "TICKER": "a-b ", "Region": None}),  # the same, written otherwise
        snap(3, 3, {"data": {"Isin": "XA1", "asset-class": "FUND"}}),  # a new attribute
        snap(4, 4, {"isin": "XA1", "assetClass": " fund", "ticker": " "}),
        snap(5, 5, {"isin": "XA1", "ticker": "CD"}),
        snap(6, 5, {"isin": "XA1", "ticker": "AB"}, loaded=6),  # corrects 5
        snap(7, 6, '{"isin": "XA1", "tick'), snap(8, 6, "[]"), snap(9, 6, "null"), snap(10, 6, None), snap(11, 6, {"ticker": "ZZ"}), snap(12, None, {"isin": "XA1", "ticker": "Q"}), snap(13, 7, {"isin": " ", "ticker": "Q"}), snap(14, 7, ""),
    ]
    want = [("XA1", 20240101, 20240103), ("XA1", 20240103, 99991231)]
    assert found(spark, data) == want
    assert found(spark, data + data) == want  # repeated rows change nothing


def test_late_snapshot_rebuilds_the_chain(spark):
    data = [snap(1, 1, {"isin": "A", "ticker": "T1"}), snap(2, 9, {"isin": "A", "ticker": "T1"}), snap(3, 5, {"isin": "A", "ticker": "T2"}, loaded=20), snap(4, 1, {"isin": "B", "ticker": "T"})]
    assert found(spark, data) == [("A", 20240101, 20240105), ("A", 20240105, 20240109), ("A", 20240109, 99991231), ("B", 20240101, 99991231)]


def test_loaded_last_counts_and_ties_go_by_id(spark):
    data = [snap(2, 1, {"isin": "A", "ticker": "new"}), snap(1, 1, {"isin": "A", "ticker": "old"}), snap(3, 2, {"isin": "A", "ticker": "new"})]
    assert found(spark, data) == [("A", 20240101, 99991231)]


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(*snap(1, 1, {"isin": "A"}), "x", "y")], SCHEMA + ", entity string, top string")
    assert rows(H.versions(H.build(df))) == [("A", 20240101, 99991231)]


def test_very_long_payload(spark):
    data = [snap(1, 1, {"isin": "A", "note": "z" * 300_000, "ticker": "T"}), snap(2, 2, {"isin": "A", "ticker": "t"})]
    assert found(spark, data) == [("A", 20240101, 99991231)]


def test_brute_force(spark):
    import random

    rnd = random.Random(3)
    data = [snap(i, rnd.randint(1, 28), {"isin": f"I{rnd.randint(1, 5)}", "ticker": rnd.choice(["A", "B", None, ""]), "region": rnd.choice(["N", "S"])}, loaded=rnd.randint(1, 28)) for i in range(300)]
    best = {}
    for i, day, body, loaded in data:
        e = json.loads(body)["isin"]
        if (e, day) not in best or (loaded, i) > best[e, day][0]:
            best[e, day] = ((loaded, i), json.loads(body))
    want, state = [], {}
    for (e, day), (_, body) in sorted(best.items()):
        old = state.get(e)
        new = dict(old[0]) if old else {}
        new |= {k: v.lower() for k, v in body.items() if k != "isin" and v}
        if old is None or new != old[0]:
            if old:
                want.append((e, old[1], day))
            state[e] = (new, day)
    number = lambda d: d.year * 10000 + d.month * 100 + d.day
    want = [(e, number(a), number(b)) for e, a, b in want] + [(e, number(d), H.OPEN_END) for e, (_, d) in state.items()]
    assert found(spark, data) == sorted(want, key=repr)


def batch(spark, data):
    return H.changes_of(spark.createDataFrame(data, SCHEMA))


def test_store_replaces_touched_chains_only(spark, tmp_path):
    kept = H.HistoryStore(spark, f"file://{tmp_path}/h", buckets=8)
    assert kept.history() is None
    kept.apply(batch(spark, [snap(1, 1, {"isin": "A", "ticker": "T1"}), snap(2, 9, {"isin": "A", "ticker": "T3"}), snap(3, 1, {"isin": "B", "ticker": "T"})]))
    before = kept.store.manifest()
    kept.apply(batch(spark, [snap(4, 5, {"isin": "A", "ticker": "T2"}, loaded=20)]))
    after = kept.store.manifest()
    assert len(after["tables"]["chains"]["generations"][-1]["buckets"]) == 1  # the late change's bucket alone was written
    assert before["tables"]["chains"]["generations"][0]["path"] == after["tables"]["chains"]["generations"][0]["path"]
    assert rows(H.versions(kept.history())) == [("A", 20240101, 20240105), ("A", 20240105, 20240109), ("A", 20240109, 99991231), ("B", 20240101, 99991231)]
    kept.apply(batch(spark, []))
    assert kept.store.manifest() == after


def test_a_late_change_reads_its_bucket_only(spark, tmp_path):
    kept = H.HistoryStore(spark, f"file://{tmp_path}/h", buckets=32)
    kept.apply(batch(spark, [snap(i, 1 + i % 9, {"isin": f"I{i}", "ticker": "T"}) for i in range(200)]))
    manifest = kept.store.manifest()
    late = batch(spark, [snap(999, 20, {"isin": "I7", "ticker": "U"})])
    buckets = kept.store.touched(manifest, "changes", late)
    assert len(buckets) == 1 and kept.store.read(manifest, "changes", buckets).count() < 40


def test_of_two_writers_one_is_refused(spark, tmp_path):
    kept = H.HistoryStore(spark, f"file://{tmp_path}/h")
    kept.apply(batch(spark, [snap(1, 1, {"isin": "A", "ticker": "T1"})]))
    stale = kept.store.manifest()
    kept.apply(batch(spark, [snap(2, 5, {"isin": "A", "ticker": "T2"})]))
    with pytest.raises(keyed.StaleWriter):
        kept.store.publish(stale)
    assert rows(H.versions(kept.history())) == [("A", 20240101, 20240105), ("A", 20240105, 99991231)]


def test_buckets_grow_and_generations_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST", 3)
    kept = H.HistoryStore(spark, f"file://{tmp_path}/h", buckets=1, rows_per_bucket=8)
    data = [snap(i, 1 + i, {"isin": f"I{i % 6}", "ticker": f"T{i}"}) for i in range(24)]
    for at in range(0, 24, 3):
        kept.apply(batch(spark, data[at : at + 3]))
    tables = kept.store.manifest()["tables"]
    assert tables["changes"]["buckets"] == 4 and all(len(t["generations"]) <= 4 for t in tables.values())
    assert rows(H.versions(kept.history())) == found(spark, data)
    assert kept.store.clean() > 0 and rows(H.versions(kept.history())) == found(spark, data)


@pytest.mark.parametrize("days", [0, 2, 400])
def test_the_split_doesnt_matter(spark, days):
    data = [snap(i, 1 + i % 9, {"isin": f"I{i % 3}", "ticker": str(i % 4)}, loaded=1 + (i * 7) % 28) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(H.versions(H.build(df, late_after_days=days))) == found(spark, data)
