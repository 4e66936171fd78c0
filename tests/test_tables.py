"""Loads that fail, are killed, race, and views that follow."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlens.operators.views import representatives
from scanlens.plans.store import Store
from scanlens.plans.tables import State, Table, Tables, buckets_in, followed
from scanlens.service import Profiler
from scanlens.sources.folders import files, put_if_absent, subfolders
from scanlens.spec import DatasetSpec

from .fixtures import item, write_page

SPEC = DatasetSpec("things", "key", "at", "number", "same", "alike")
SCHEMA = T.StructType().add("key", "string").add("at", "long").add("number", "long").add("same", "string").add("alike", "string").add("note", "string")


def rows_of(spark, rows):
    """(key, at, same, alike, note), numbered from 0."""
    return spark.createDataFrame([(k, a, i, s, x, n) for i, (k, a, s, x, n) in enumerate(rows)], "key string, at long, place long, same string, alike string, note string")


def load(tables, rows, last_wins=True):
    return tables.merge_rows(SPEC, SCHEMA, rows_of(tables.spark, rows), last_wins=last_wins, keep=("number",) if last_wins else (), number="place")


def content(tables, name="things", version=None):
    return {r.key: r for r in tables.pin(version).read(name, SCHEMA).collect()}


def test_a_load_writes_its_own_buckets_only(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), buckets=8)
    assert load(tables, [(f"k{i}", i, None, None, "old") for i in range(40)]) == (40, 0)
    before = tables.pin()
    assert load(tables, [("k3", 100, None, None, "new"), ("new", 5, None, None, "new")]) == (1, 1)
    after, touched = tables.pin(), {str(b) for b in buckets_in(rows_of(spark, [("k3", 0, None, None, ""), ("new", 0, None, None, "")]), F.col("key"), 8)}
    assert {b for b, p in after.tables["things"].folders.items() if before.tables["things"].folders.get(b) != p} == touched and len(touched) <= 2
    now = content(tables)
    assert len(now) == 41 and now["k3"].note == "new" and now["k3"].number == content(tables, version=1)["k3"].number
    assert now["new"].number > max(r.number for k, r in now.items() if k != "new")
    assert load(tables, [("k3", 200, None, None, "skipped"), ("k4", 200, None, None, "skipped")], last_wins=False) == (0, 2) and content(tables)["k3"].note == "new"


def test_a_failed_load_bars_nobody(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    load(tables, [("a", 1, "s", "x", "old")])
    bad = rows_of(spark, [("a", 2, "s", "x", "bad"), ("b", 2, "s", "x", "bad")]).withColumn("note", F.when(F.col("key") == "b", F.raise_error(F.lit("disk full")).cast("string")).otherwise(F.col("note")))
    with pytest.raises(Exception, match="disk full"):
        tables.merge_rows(SPEC, SCHEMA, bad, last_wins=True, keep=("number",), number="place")
    assert tables.latest() == 1 and content(tables)["a"].note == "old"
    assert load(tables, [("a", 3, "s", "x", "good")]) == (0, 1) and content(tables)["a"].note == content(tables, "things_exact")["a"].note == "good"


def test_a_killed_load_bars_nobody(spark, tmp_path, monkeypatch):
    """All data is written, and the driver is lost before the log's entry is put."""
    tables = Tables(spark, str(tmp_path))
    load(tables, [("a", 1, None, None, "old")])
    with monkeypatch.context() as m:
        m.setattr("scanlens.plans.tables.put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            load(tables, [("a", 2, None, None, "lost")])
    assert content(tables)["a"].note == "old" and len(subfolders(spark, f"{tmp_path}/data/things")) == 2
    load(tables, [("a", 3, None, None, "good")])
    assert content(tables)["a"].note == content(tables, "things_series")["a"].note == "good"
    assert tables.vacuum(keep=1, seconds=3600) == [] and len(tables.vacuum(keep=1, seconds=0)) == 6
    assert content(tables)["a"].note == "good" and files(spark, f"{tmp_path}/_log") == ["000000000002.json"]


@pytest.mark.parametrize("last_wins", [True, False])
def test_of_two_loads_at_once_both_are_in(spark, tmp_path, last_wins):
    tables = Tables(spark, str(tmp_path), buckets=2)
    load(tables, [("a", 1, None, None, "old")])
    gate, made = threading.Barrier(2, timeout=120), []

    class Together(Tables):
        def written(self, name, *args):
            out = super().written(name, *args)
            if name == "things":
                made.append(1)
                if len(made) <= 2:
                    gate.wait()  # both have merged with the same state
            return out

    def run(note):
        load(Together(spark, str(tmp_path), buckets=2), [(f"{note}{i}", 5, None, None, note) for i in range(6)] + [("both", 5, None, None, note)], last_wins)

    threads = [threading.Thread(target=run, args=(n,)) for n in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    now = content(tables)
    assert len(made) == 3 and tables.latest() == 3  # one of them merged again
    assert set(now) == {"a", "both", *(f"{n}{i}" for n in "xy" for i in range(6))} == set(content(tables, "things_exact"))
    assert len({r.number for r in now.values()}) == len(now)


def test_loads_of_different_tables_dont_merge_again(spark, tmp_path):
    tables, calls = Tables(spark, str(tmp_path)), []

    def make(seen):
        calls.append(seen.version)
        if len(calls) == 1:
            tables.create("other")  # overtakes
        return {"mine": Table()}, {"mine"}, None

    tables.commit(make)
    assert calls == [0] and set(tables.pin().tables) == {"mine", "other"} and tables.latest() == 2


def test_put_if_absent(spark, tmp_path):
    path, done = f"{tmp_path}/log/1.json", []
    threads = [threading.Thread(target=lambda i=i: done.append((put_if_absent(spark, path, str(i) * 1000), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [i for ok, i in done if ok]
    assert len(winner) == 1 and open(path).read() == str(winner[0]) * 1000 and files(spark, f"{tmp_path}/log") == ["1.json"]


def test_views_follow_random_loads(spark, tmp_path):
    rng, tables = random.Random(4), Tables(spark, str(tmp_path), buckets=3)
    pick = lambda *x: rng.choice([*x, None])
    for step in range(4):
        keys = rng.sample([f"k{i}" for i in range(25)], 9)
        load(tables, [(k, pick(1, 2, 3), pick("s", "t", "u"), pick("x", "y"), f"load {step}") for k in keys], last_wins=step != 2)
        rows = tables.pin().read("things", SCHEMA)
        for kind in ("exact", "series"):
            want = sorted(map(tuple, representatives(rows, SPEC, kind).collect()), key=str)
            assert sorted(map(tuple, tables.pin().read(f"things_{kind}", SCHEMA).collect()), key=str) == want
    tables.refresh(SPEC, SCHEMA)
    assert sorted(map(tuple, tables.pin().read("things_series", SCHEMA).collect()), key=str) == want


def test_following_ranks_touched_groups_only(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    load(tables, [(f"k{i}", i, f"s{i % 4}", None, "") for i in range(12)])
    at = tables.pin()
    groups = spark.createDataFrame([("s1",)], "group__ string")
    plan = followed(at.read("things", SCHEMA), at.read("things_exact", SCHEMA), groups, SPEC, "exact")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ") :]
    assert "LeftSemi" in window and "LeftAnti" in plan[: plan.index("Window ")]
    first = tables.pin().tables["things_exact"].folders
    load(tables, [("k1", 99, "s1", None, "newer")])
    second = tables.pin().tables["things_exact"].folders
    assert sum(first.get(b) != p for b, p in second.items()) == 1


def test_an_overview_is_of_one_state(spark, tmp_path):
    run, store = tmp_path / "run", Store(spark, str(tmp_path / "store"))
    write_page(run, "bold", 1, [item("bold", "a")])
    store.load_run(str(run), ["bold"])
    old = Profiler(store).pinned()
    write_page(run, "bold", 2, [item("bold", "b", md5="b" * 32), item("bold", "c", md5="b" * 32)])
    store.load_run(str(run), ["bold"])
    assert old.modality_overview("bold")["row_counts"] == {"raw": 1, "exact": 1, "series": 1}
    assert Profiler(store).modality_overview("bold")["row_counts"]["raw"] == 3
    assert store.snapshot("bold", "exact").count() == 2 and isinstance(store.state(), State)


def test_rows_without_refresh(spark, tmp_path):
    run, store = tmp_path / "run", Store(spark, str(tmp_path / "store"))
    write_page(run, "bold", 1, [item("bold", "a")])
    store.load_run(str(run), ["bold"], refresh=False)
    assert store.read("bold").count() == 1 and store.snapshot("bold", "series") is None
    store.refresh(["bold"])
    assert store.snapshot("bold", "series").count() == 1 and store.versions()[-3:] == (1, 2, 2)
