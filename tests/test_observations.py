"""Parsing, loading, profiling and serving of observations."""

import json
import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlens import cli
from scanlens.operators import profile
from scanlens.operators.filters import ObservationFilters
from scanlens.plans.parse import parse, validated
from scanlens.plans.store import Store
from scanlens.service import Answers, Api, Profiler
from scanlens.sources import csv_report, dump, pages
from scanlens.spec import MODALITIES, modality
from scanlens.streaming.ingest import ingest

from .fixtures import extended, item, write_page, write_run


def items_df(spark, *items):
    return spark.createDataFrame([(json.dumps(x), f"p/page-{i:06d}.json", i, 1) for i, x in enumerate(items)], "value string, raw_payload_path string, source_page int, item_index long")


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    write_run(root)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    return store, store.load_run(str(root)), root


def test_spec_sizes():
    assert {m: len(s.schema) for m, s in MODALITIES.items()} == {"T1w": 158, "T2w": 158, "bold": 140}
    assert [len(modality(m).metric_fields) for m in ("T1w", "bold")] == [68, 44]
    assert len(modality("T1w").series_fields) == 17 and len(modality("bold").series_fields) == 20
    assert [len(modality(m).important_fields) for m in ("T1w", "T2w", "bold")] == [9, 8, 10]
    with pytest.raises(ValueError):
        modality("t1w")


def test_parse_keeps_what_has_no_column(spark):
    r = parse(items_df(spark, item("T1w", "x", bids={"FlipAngle": 7, "ImageType": ["ORIGINAL"]}, spare_flag=True)), "T1w").first()
    assert (r.source_api_id, r.flip_angle, r.mr_acquisition_type, r.echo_time, r.settings_fd_thres, r.settings_testing, r.pipeline_pred) == ("x", 7, "3D", 0.002, 0.2, False, 1)
    assert r.bids_meta_extra == {"CoilRemark": "kept", "ImageType": '["ORIGINAL"]'}
    assert set(r.payload_extra) == {"spare_metric", "spare_flag", "_links"} and r.provenance_extra == {"origin_remark": "kept"} and r.provenance_settings_extra == {"extra_switch": "true"}
    assert r.source_created_at == datetime(2021, 3, 14, 5, 12, 5) and r.modality == "T1w" and r.dedupe_exact_key == "a" * 32 and r.dedupe_status == "pending"


def test_parse_bold_rating_and_structural_rating(spark):
    r = parse(items_df(spark, item("bold", "x", bids={"TaskName": "rest"})), "bold").first()
    assert (r.rating_label, r.rating_name, r.rating_comment, r.rating_extra) == ("accept", "second reader", "sharp enough", {"rater": "kept"}) and r.task_name == "rest"
    s = item("T1w", "x")
    s["rating"] = {"rating": "lost"}
    s["bids_meta"]["TaskName"] = "x"
    r = parse(items_df(spark, s), "T1w").first()
    assert "rating" not in r.payload_extra and r.bids_meta_extra["TaskName"] == "x"


def test_series_keys(spark):
    base = item("T1w", "1", session="Ses 1")
    same = [item("T1w", "2", md5="b" * 32, session=" ses   1 ", size_x=float(base["size_x"])), item("T1w", "3", session="ses 1", bids={"run_id": ""})]
    other = [item("T1w", "4"), item("T1w", "5", session="Ses 1", spacing_x=0.9), item("T1w", "6", session="Ses 1", bids={"EchoTime": 0.0021})]
    keys = [r.dedupe_series_key for r in parse(items_df(spark, base, *same, *other), "T1w").orderBy("source_api_id").collect()]
    assert len(set(keys[:3])) == 1 and len(set(keys)) == 4


def test_required_columns(spark):
    bad = item("T1w", "x")
    del bad["cjv"]
    rows = parse(items_df(spark, item("T1w", "y"), bad), "T1w")
    with pytest.raises(Exception, match="missing required columns: cjv"):
        validated(rows, modality("T1w"))[0].collect()
    good, rejected = validated(rows, modality("T1w"), quarantine=True)
    assert [r.source_api_id for r in good.collect()] == ["y"] and rejected.first().missing == ["cjv"]


def test_integers_of_float_text(spark):
    r = parse(items_df(spark, item("T1w", "x", size_x=176.0, bids={"FlipAngle": 7.5})), "T1w").first()
    assert r.size_x == 176 and r.flip_angle is None


def test_pages(spark, tmp_path):
    write_page(tmp_path, "T1w", 7, [item("T1w", "a"), item("T1w", "b")])
    found = pages.read_items(spark, str(tmp_path), "T1w").orderBy("item_index").collect()
    assert [(r.source_page, r.item_index, json.loads(r.value)["_id"]) for r in found] == [(7, 1, "a"), (7, 2, "b")]
    assert pages.read_items(spark, str(tmp_path), "bold") is None
    df = spark.createDataFrame([('{"_items": "bad"}',), ("{}",)], "value string")
    assert df.where("value = '{}'").select(pages.page_items(F.col("value")).alias("x")).first().x == []
    with pytest.raises(Exception, match="not a list"):
        df.select(pages.page_items(F.col("value"))).collect()
    with pytest.raises(ValueError):
        pages.resolve_run_root(spark, run_root="a", run_id="b")
    (tmp_path / "runs" / "1" / "raw").mkdir(parents=True)
    (tmp_path / "runs" / "2" / "raw").mkdir(parents=True)
    assert pages.resolve_run_root(spark, data_root=str(tmp_path)).endswith("runs/2")
    with pytest.raises(FileNotFoundError):
        pages.resolve_run_root(spark, run_root=str(tmp_path / "runs"))


def test_load_and_views(loaded):
    store, summary, _ = loaded
    assert summary.to_dict()["modalities"]["T1w"] == {"page_count": 2, "observation_count": 3, "inserted_count": 3, "updated_count": 0, "rejected_count": 0}
    p = Profiler(store)
    assert p.modality_overview("T1w")["row_counts"] == {"raw": 3, "exact": 2, "series": 3}
    assert p.modality_overview("T1w")["source_created_at_range"] == {"min": "2021-03-14T05:12:05", "max": "2021-03-14T07:12:05"}
    assert {r.source_api_id for r in p.view("T1w", "exact").collect()} == {"def", "fed"}
    assert len(p.overview()["modalities"]) == 3


def test_profile_of_a_modality(loaded):
    p = Profiler(loaded[0])
    got = p.modality_profile("T1w")
    assert got["top_values"]["manufacturer"] == [{"value": "Lumen", "count": 2}, {"value": "GE", "count": 1}]
    assert next(r for r in got["missingness"] if r["field"] == "session_id") == {"field": "session_id", "missing_count": 1, "missing_fraction": pytest.approx(1 / 3)}
    assert {"key": "spare_metric", "row_count": 3} in got["extras"]["payload_extra"]["keys"] and got["extras"]["payload_extra"]["nonempty_row_count"] == 3
    cjv = got["metrics"][0]
    assert cjv["field"] == "cjv" and (cjv["value_count"], cjv["min"], cjv["max"]) == (3, 0.1, 0.7) and cjv["mean"] == pytest.approx(0.4)
    twins = got["duplicates"]["exact"]
    assert (twins["duplicate_group_count"], twins["duplicate_row_count"], twins["histogram"]) == (1, 2, [{"group_size": 2, "group_count": 1}])
    assert [s["source_api_id"] for s in twins["sample_groups"][0]["samples"]] == ["def", "abc"]
    assert p.distribution("bold", "task_id") == [{"value": "flanker", "count": 1}, {"value": "rest", "count": 1}]


def test_metric_distribution(loaded):
    got = Profiler(loaded[0]).metric_distribution("T1w", "cjv", bins=3)
    assert (got["value_count"], got["quantiles"]["p01"], got["quantiles"]["p50"], got["quantiles"]["p99"]) == (3, pytest.approx(0.106), pytest.approx(0.4), pytest.approx(0.694))
    assert [b["count"] for b in got["histogram"]] == [1, 1, 1] and got["histogram"][-1]["end"] == 0.7
    with pytest.raises(ValueError):
        Profiler(loaded[0]).metric_distribution("T1w", "fd_mean")


def test_filters(loaded):
    p = Profiler(loaded[0])
    ge = ObservationFilters(manufacturers=("GE",))
    assert p.modality_overview("T1w", ge)["row_counts"] == {"raw": 1, "exact": 1, "series": 1}
    lumen = ObservationFilters(manufacturers=("Lumen",), created_to=datetime(2021, 3, 14, 6, 0, tzinfo=UTC))
    assert p.view("T1w", "exact", lumen).count() == 0  # the representative is the later one
    assert Profiler(loaded[0], filter_first=True, snapshots=False).view("T1w", "exact", lumen).count() == 1
    assert lumen.echo()["manufacturers"] == ["Lumen"] and p.view("T1w", "raw", ObservationFilters(tasks=("rest",))).count() == 0


def test_load_again_and_update(spark, tmp_path):
    run, store = tmp_path / "run", Store(spark, str(tmp_path / "store"))
    write_page(run, "T1w", 1, [item("T1w", "a"), item("T1w", "b", session="s1")])
    assert (s := store.load_run(str(run)).modalities["T1w"]).inserted_count == 2 and s.updated_count == 0
    before = {r.source_api_id: (r.id, r.inserted_at) for r in store.read("T1w").collect()}
    write_page(run, "T1w", 1, [item("T1w", "a", manufacturer="GE")])
    write_page(run, "T1w", 2, [item("T1w", "a", manufacturer="Philips"), item("T1w", "c")])
    s = store.load_run(str(run)).modalities["T1w"]
    assert (s.observation_count, s.inserted_count, s.updated_count) == (3, 1, 2)
    rows = {r.source_api_id: r for r in store.read("T1w").collect()}
    assert rows["a"].manufacturer == "Philips" and (rows["a"].id, rows["a"].inserted_at) == before["a"] and len(rows) == 3
    assert rows["c"].id > max(i for i, _ in before.values()) and store.snapshot("T1w", "exact").count() == 1


def test_dump(spark, tmp_path):
    root, store = tmp_path / "dump", Store(spark, str(tmp_path / "store"))
    root.mkdir()
    path = root / "archive.T1w.json"
    path.write_text(json.dumps([extended(item("T1w", "a")), extended(item("T1w", "b", md5="b" * 32))]))
    (root / "other.txt").write_text("x")
    s = store.load_dump(str(root)).modalities["T1w"]
    assert (s.page_count, s.inserted_count, s.updated_count) == (1, 2, 0)
    r = store.read("T1w").where("source_api_id = 'a'").first()
    assert (r.flip_angle, r.cnr, r.source_page) == (12, 0.375, None) and r.raw_payload_path.endswith("archive.T1w.json#item=1")
    assert r.source_created_at == r.source_updated_at == datetime(2021, 3, 14, 5, 12, 5) and json.loads(r.payload_extra["nested"]) == [{"deep": 42}]
    s = store.load_dump(str(root)).modalities["T1w"]
    assert (s.inserted_count, s.updated_count) == (0, 2) and store.read("T1w").count() == 2
    path.write_text(json.dumps([extended(item("T1w", x)) for x in "abc"]))
    s = store.load_dump(str(root)).modalities["T1w"]
    assert (s.inserted_count, s.updated_count) == (1, 2)
    with pytest.raises(FileNotFoundError):
        dump.resolve_dump_root(spark, str(tmp_path / "none"))


def test_same_key_by_page_and_dump(spark, tmp_path):
    one = item("T1w", "a", size_x=64.0)
    (tmp_path / "d.T1w.json").write_text(json.dumps([one | {"size_x": 64}]))
    a = parse(items_df(spark, one), "T1w").first().dedupe_series_key
    assert parse(dump.read_items(spark, str(tmp_path / "d.T1w.json")), "T1w").first().dedupe_series_key == a


def test_unknown_wrappers(spark):
    df = spark.createDataFrame([('{"a": {"$regex": "x"}}',)], "value string")
    with pytest.raises(Exception, match="unknown wrapper"):
        df.select(dump.unwrapped(F.col("value"))).collect()


def test_values_that_are_not_finite(spark):
    from scanlens.operators import profile

    df = spark.createDataFrame([(0.4,), (float("nan"),), (0.8,), (float("inf"),), (None,)], "fber double")
    r = profile.metric_summaries(df, ["fber"]).first()
    assert (r.value_count, r.missing_count, r.min, r.max) == (2, 3, 0.4, 0.8)
    assert profile.missingness(df, ["fber"]).first().missing_count == 1
    assert [(b.start, b.end, b["count"]) for b in profile.histogram(df.where("fber = 0.4"), "fber").collect()] == [(0.4, 0.4, 1)]


def test_empty_tables(spark):
    from scanlens.operators import duplicates, profile

    for name, spec in MODALITIES.items():
        df = spark.createDataFrame([], spec.struct)
        assert profile.metric_summaries(df, list(spec.metric_fields)).count() == len(spec.metric_fields)
        assert [r.missing_fraction for r in profile.missingness(df, list(spec.important_fields)).collect()] == [0.0] * len(spec.important_fields)
        assert profile.histogram(df, spec.metric_fields[0]).count() == 0
        assert profile.metric_stats(df, spec.metric_fields[0]).first().missing_fraction == 0
        assert duplicates.totals(duplicates.groups(df, spec, "exact")).first().duplicate_row_count == 0
        assert name in MODALITIES


def test_ties_and_null_times(spark):
    from scanlens.operators import views
    from scanlens.spec import DatasetSpec

    spec = DatasetSpec("t", "k", "at", "id", "e", "s")
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "b", 5, "x"), (3, "c", 5, "x"), (4, "d", None, None), (5, "e", None, None)], "id long, k string, at long, e string").withColumn("s", F.col("e"))
    assert {r.id for r in views.view(df, spec, "exact").collect()} == {3, 4, 5}
    with pytest.raises(ValueError):
        views.view(df, spec, "other")


def test_api_and_cache(loaded):
    api = Api(Profiler(loaded[0]))
    status, body, kept = api.answer("/modalities/T1w/metrics/cjv", bins=3)
    assert status == 200 and body["value_count"] == 3 and not kept
    assert api.answer("/modalities/T1w/metrics/cjv", bins=3)[2]
    assert api.answer("/modalities/T1w/metrics/none")[0] == api.answer("/modalities/none/missingness")[0] == api.answer("/x")[0] == 404
    assert api.answer("/modalities/T1w/metrics/cjv", bins=0)[0] == 422 and api.answer("/health")[0] == 200
    assert len(api.answer("/modalities")[1]) == 3 and api.answer("/modalities/bold/duplicates/series")[0] == 200
    now = [100.0]
    answers = Answers(5, 2, now=lambda: now[0])
    answers.keep("a", 1)
    assert answers.recall("a").answer == 1 and answers.recall("b") is None
    answers.keep("b", 2)
    answers.recall("a")
    answers.keep("c", 3)
    assert answers.recall("b") is None and answers.recall("a").answer == 1
    now[0] += 6
    assert answers.recall("a") is None
    answers.keep("a", 4)
    answers.forget()
    assert answers.recall("a") is None


def test_quantiles_of_groups(spark):
    """Exact percentiles as a sort gives them: ties, few rows, null groups, groups without values."""
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3001)] + [("b", float(rng.randrange(4))) for _ in range(500)] + [(None, 1.5), (None, 2.5), ("c", None), ("d", float("nan")), ("e", 7.0)]
    got = {r.g: r for r in profile.metric_stats(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"]).collect()}
    assert set(got) == {"a", "b", None, "c", "d", "e"}
    for g, r in got.items():
        own = sorted(v for k, v in rows if k == g and v is not None and v == v)
        for name, p in profile.QUANTILES.items():
            want = None if not own else float(np.quantile(own, p))
            assert (r[name] is None) if want is None else r[name] == pytest.approx(want, abs=1e-12)


def test_written_profile_and_cli(spark, loaded, tmp_path, capsys):
    store, _, run = loaded
    assert cli.main(["profile", "--store", store.root, "--out", str(tmp_path), "--modality", "T1w"], spark) == 0
    root = json.loads(capsys.readouterr().out)["written"]
    assert json.loads((tmp_path / root / "overview.json").read_text())["modalities"][0]["row_counts"]["raw"] == 3
    assert cli.main(["load-run", "--store", str(tmp_path / "s"), "--run-root", str(run), "--modality", "bold"], spark) == 0
    assert json.loads(capsys.readouterr().out)["modalities"]["bold"]["inserted_count"] == 2
    assert cli.main(["refresh", "--store", str(tmp_path / "s"), "--modality", "bold"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_streamed_pages(spark, tmp_path):
    run, store = tmp_path / "run", Store(spark, str(tmp_path / "store"))
    write_page(run, "bold", 1, [item("bold", "a")])
    ingest(store, str(run), "bold", str(tmp_path / "check")).awaitTermination()
    write_page(run, "bold", 2, [item("bold", "b", md5="b" * 32), item("bold", "a", manufacturer="GE")])
    ingest(store, str(run), "bold", str(tmp_path / "check")).awaitTermination()
    assert {r.source_api_id: r.manufacturer for r in store.read("bold").collect()} == {"a": "GE", "b": "Lumen"}


def test_csv_reports(spark, tmp_path):
    from scanlens.operators import compare

    path = tmp_path / "demo.csv"
    path.write_text('fd_mean,efc,"no,te"\r\n.11,.91,"a ""q"", b"\r\n\r\n.18,.96\r\n.27,1.04,"two\nlines"\r\n0x10,1d,\r\n')
    report = csv_report.read_report(spark, str(path))
    assert report.columns == ["fd_mean", "efc", "no,te"] and report.count() == 4
    assert csv_report.infer_modality("demo.csv", report.columns) == "bold" and csv_report.infer_modality("my-T2w.csv", []) == "T2w" and csv_report.infer_modality("x.csv", ["efc"]) is None
    rows = {r.field: r for r in compare.report_summary(report, list(modality("bold").metric_fields)).collect()}
    assert (rows["fd_mean"].value_count, rows["fd_mean"].missing_count, rows["efc"].max, rows["tsnr"].value_count) == (3, 1, 1.04, 0)
    assert compare.report_histogram(report, "fd_mean").count() == 2
    assert csv_report.finalize([("a", "bold", report), ("b", "bold", report)])["bold"] is report
    with pytest.raises(ValueError):
        csv_report.finalize([("a", None, report)])
    with pytest.raises(ValueError):
        csv_report.read_report(spark, "x.txt")
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        csv_report.read_report(spark, str(tmp_path / "empty.csv"))
