"""The profile of a view and the duplicates of both kinds by one scan, against the single operators."""

import pytest
from pyspark.sql import functions as F

from scanlens.operators import duplicates, profile
from scanlens.plans import queries
from scanlens.spec import DatasetSpec

SF = "/root/testdata/sf0.001"
SPEC = DatasetSpec("odd", "key", "at", "key", "same", "like", category_fields=("colour", "value"), metric_fields=("value", "size"), important_fields=("colour", "same"), extra_fields=("extra", "notes"), sample_fields=("key", "colour"))
SCHEMA = "key long, at int, same string, like string, colour string, value string, size double, extra string, notes map<string, string>, part string, known int"
ROWS = [
    (1, 3, "x", "p", "red", "1.5", 2.0, '{"a": 1, "b": 2}', {"k": "v"}, "clash", 1),
    (2, None, "x", "p", "", "nan", float("nan"), "{}", {}, "clash", 1),
    (3, 9, "x", None, None, None, float("inf"), None, None, None, None),
    (4, 9, None, None, "red", "-2", -1.0, "no object", {"k": "w", "l": None}, "", 2),
    (5, 1, "y", "q", "blue", "1.5", None, '{"a": null}', {"l": "x" * 100_000}, "", 2),
    (5, 1, "y", "q", "blue", "1.5", None, '{"a": null}', {"l": "x" * 100_000}, "", 2),
]


def scans(df) -> int:
    """How often the plan that has run reads files."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return final.count("FileScan")


def check(df, spec, top_n=10, key_limit=25):
    found = [r.asDict() for r in profile.whole(df, spec, top_n=top_n, key_limit=key_limit).collect()]
    heads = {(r["part"], r["field"]): r for r in found if r["rank"] is None}
    ranked = lambda part, field: [(r["value"], r["row_count"]) for r in sorted((r for r in found if r["rank"] and (r["part"], r["field"]) == (part, field)), key=lambda r: r["rank"])]
    assert len(heads) == 1 + len(spec.important_fields) + len(spec.metric_fields) + len(spec.category_fields) + len(spec.extra_fields)
    one = profile.view_summary(df, spec).first()
    assert tuple(heads["view", spec.name][c] for c in ("row_count", "first_at", "last_at")) == tuple(one)
    for r in profile.missingness(df, list(spec.important_fields)).collect():
        h = heads["missing", r.field]
        assert (h["position"], h["row_count"] - h["known_count"]) == (r.position, r.missing_count)
    for r in profile.metric_summaries(df, list(spec.metric_fields)).collect():
        h = heads["metric", r.field]
        assert (h["position"], h["known_count"], h["row_count"] - h["known_count"], h["min"], h["max"]) == (r.position, r.value_count, r.missing_count, r.min, r.max)
        assert h["mean"] == (r.mean if r.mean is None else pytest.approx(r.mean))
    for c in spec.category_fields:
        assert ranked("category", c) == [tuple(r) for r in profile.top_values(df, c, top_n).collect()]
        assert heads["category", c]["distinct_count"] == profile.top_values(df, c, 1_000_000).count()
    for c in spec.extra_fields:
        assert ranked("extra", c) == [tuple(r) for r in profile.extra_key_counts(df, c, key_limit).collect()]
        assert (heads["extra", c]["known_count"], heads["extra", c]["distinct_count"]) == tuple(profile.extra_key_totals(df, c).first())


@pytest.mark.parametrize("top_n, key_limit", [(10, 25), (1, 2), (2, 1)])
def test_odd_rows(spark, top_n, key_limit):
    check(spark.createDataFrame(ROWS, SCHEMA).repartition(3), SPEC, top_n, key_limit)


def test_events(spark):
    check(queries.events(spark, SF), queries.EVENTS)


def test_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert profile.whole(none, SPEC).count() == 0 and duplicates.bundle(none, SPEC).count() == 0


def test_one_scan(spark):
    df = queries.events(spark, SF)
    assert scans(profile.whole(df, queries.EVENTS)) == 1
    assert scans(duplicates.bundle(df, queries.EVENTS)) == 1


@pytest.mark.parametrize("limit", [1, 10])
@pytest.mark.parametrize("make", [lambda spark: (spark.createDataFrame(ROWS, SCHEMA), SPEC), lambda spark: (queries.documents(spark, SF), queries.DOCUMENTS), lambda spark: (queries.events(spark, SF), queries.EVENTS)])
def test_duplicates(spark, make, limit):
    df, spec = make(spark)
    found = [r.asDict() for r in duplicates.bundle(df, spec, group_limit=limit).collect()]
    top = spark.createDataFrame([(r["kind"], r["group_key"]) for r in found if r["part"] == "group"] or [("none", "none")], "kind string, group_key string")
    members = duplicates.samples_of(df, spec, top, member_limit=3).collect()
    for kind in ("exact", "series"):
        groups = duplicates.groups(df, spec, kind)
        sizes = [r for r in found if (r["kind"], r["part"]) == (kind, "size")]
        assert sum(r["group_size"] * r["group_count"] for r in sizes) == df.count()
        more = sorted(((r["group_size"], r["group_count"]) for r in sizes if r["group_size"] > 1), reverse=True)
        assert more == [tuple(r) for r in duplicates.size_histogram(groups).collect()]
        want = [tuple(r) for r in duplicates.top_groups(groups, limit).collect()]
        got = sorted((r for r in found if (r["kind"], r["part"]) == (kind, "group")), key=lambda r: r["rank"])
        assert [(r["group_key"], r["group_size"], r["first_created_at"], r["last_created_at"]) for r in got] == want
        own = duplicates.samples(df, spec, kind, limit, 3).drop("group_size").collect()
        key = lambda r: (r.group_key, r.member)
        assert [tuple(r)[1:] for r in sorted((m for m in members if m.kind == kind), key=key)] == [tuple(r) for r in sorted(own, key=key)]


def test_report_histogram_parses_each_cell_once_a_scan(spark, tmp_path):
    from scanlens.functions.values import strict_number
    from scanlens.operators import compare

    texts = [" 1", "2\t", "\n3.5\r", "+4.", ".5e1", "-0", "1e999", "-1e999", "0x10", "1d", "2f", "NaN", "Infinity", "", " ", None, "1 2", "7\u00a0", "\u00a07", "1\u0085", "1_0", "e5", ".", "8\n\n", "9" * 400]
    want = [1.0, 2.0, 3.5, 4.0, 5.0, -0.0, *[None] * 17, 8.0, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, efc string")
    got = df.select("i", strict_number(F.col("efc")).alias("x")).orderBy("i").collect()
    assert len(texts) == len(want) and [r.x for r in got] == want
    df.write.parquet(str(tmp_path / "report"))
    out = compare.report_histogram(spark.read.parquet(str(tmp_path / "report")), "efc")
    assert [(b.bin, b.start, b.end, b["count"]) for b in out.orderBy("bin").collect()] == [(0, 0.0, 2.6666666666666665, 3), (1, 2.6666666666666665, 5.333333333333333, 3), (2, 5.333333333333333, 8.0, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line]
