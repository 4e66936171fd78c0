"""The engine's operators on general tables: one query each, with the same question in DuckDB's SQL.

Events, documents and lineitem stand in for observations through specs of their own. Doubles are rounded to
six digits on both sides, because sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels, values
from ..operators import compare, duplicates, profile, views
from ..operators.filters import ObservationFilters, apply_filters
from ..sources.folders import new_shared_folder
from ..sources.pages import item_manifest, missing_of, page_items, page_summary, sample_summary
from ..spec import DatasetSpec, modality
from . import merge, paging
from .tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = DatasetSpec(
    "events", "event_id", "ts", "event_id", "exact_key", "series_key", {"manufacturers": "event_type", "tasks": "event_type"}, category_fields=("event_type",), metric_fields=("value", "user_number"),
    important_fields=("event_type", "value", "kind", "maybe"), extra_fields=("props",), sample_fields=("event_id", "ts", "event_type"),
)
DOCUMENTS = DatasetSpec("documents", "doc_id", "n_chars", "doc_id", "exact_key", "series_key", {"manufacturers": "lang"}, category_fields=("lang", "source"), sample_fields=("doc_id", "lang", "n_chars"))
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

EVENTS_SQL = """e AS (SELECT event_id, ts, user_id, event_type, value, props, md5(props) AS exact_key, user_id || '|' || event_type AS series_key,
 CAST(user_id AS DOUBLE) AS user_number, nullif(event_type, 'error') AS kind, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN NULL ELSE 'x' END AS maybe FROM events)"""
SERIES_SQL = f"""WITH {EVENTS_SQL}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM e) WHERE rn = 1)"""
TYPES, FROM, TO = ("click", "purchase"), datetime(2020, 1, 1), datetime(2030, 1, 1)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("event_type"))
    maybe = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 5 == 0, None).otherwise("x")
    return table(spark, d, "events").select("*", F.md5(F.col("props").cast("binary")).alias("exact_key"), key.alias("series_key"), F.col("user_id").cast("double").alias("user_number"), F.expr("nullif(event_type, 'error')").alias("kind"), maybe.alias("maybe"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("exact_key"), F.lit(None).cast("string").alias("series_key"))


DOCUMENTS_SQL = "d AS (SELECT doc_id, lang, source, n_chars, md5(text) AS exact_key FROM documents)"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


PERCENTILES = ", ".join(f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY value), 6) AS {n}" for n, p in profile.QUANTILES.items())
STATS_SQL = f"""CAST(count(*) AS BIGINT) AS row_count, CAST(count(value) AS BIGINT) AS value_count, CAST(count(*) - count(value) AS BIGINT) AS missing_count,
 CASE WHEN count(*) > 0 THEN round((count(*) - count(value)) / CAST(count(*) AS DOUBLE), 6) ELSE 0 END AS missing_fraction,
 round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, {PERCENTILES}"""
STATS = ["min", "max", "mean", "stddev", *profile.QUANTILES]


@query(f"{SERIES_SQL} SELECT {STATS_SQL} FROM s")
def metric_distribution(spark, d):
    """The flagship: statistics and exact percentiles of a metric over the series view."""
    out = profile.metric_stats(views.view(events(spark, d), EVENTS, "series"), "value")
    return out.select("row_count", "value_count", "missing_count", *r6("missing_fraction", *STATS))


HISTOGRAM_SQL = """, b AS (SELECT min(value) AS mn, max(value) AS mx FROM s), w AS (SELECT mn, mx, (mx - mn) / 20 AS w FROM b),
h AS (SELECT least(CAST(floor((value - mn) / w) AS INTEGER), 19) AS bin, count(*) AS c FROM s CROSS JOIN w GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(mn + i * w, 6) AS start, round(CASE WHEN i = 19 THEN mx ELSE mn + (i + 1) * w END, 6) AS "end", CAST(coalesce(c, 0) AS BIGINT) AS count
FROM w CROSS JOIN (SELECT unnest(range(0, 20)) AS i) LEFT JOIN h ON h.bin = i"""


@query(SERIES_SQL + HISTOGRAM_SQL)
def metric_histogram(spark, d):
    return profile.histogram(views.view(events(spark, d), EVENTS, "series"), "value", 20).select("bin", *r6("start", "end"), "count")


@query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(exact_key, CAST(doc_id AS VARCHAR)) ORDER BY n_chars DESC NULLS LAST, doc_id DESC) AS rn FROM d) WHERE rn = 1""")
def view_exact(spark, d):
    return views.view(documents(spark, d), DOCUMENTS, "exact").select("doc_id", "lang", "n_chars")


@query(f"{SERIES_SQL} SELECT event_id, ts, event_type, value FROM s WHERE event_type IN {TYPES} AND ts >= TIMESTAMP '{FROM}' AND ts <= TIMESTAMP '{TO}'")
def view_series_then_filter(spark, d):
    """Representatives first, filters after."""
    return views.view(events(spark, d), EVENTS, "series", ObservationFilters(manufacturers=TYPES, created_from=FROM, created_to=TO)).select("event_id", "ts", "event_type", "value")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM e WHERE event_type IN {TYPES}) WHERE rn = 1""")
def view_filter_then_series(spark, d):
    """The other order: representatives among the rows that pass."""
    df = events(spark, d).withColumn("series_key", F.col("user_id").cast("string"))
    return views.view(df, EVENTS, "series", ObservationFilters(manufacturers=TYPES), filter_first=True).select("event_id", "ts", "event_type", "value")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-10'")
def view_raw_filtered(spark, d):
    return views.view(events(spark, d), EVENTS, "raw", ObservationFilters(tasks=TYPES, created_from=datetime(2024, 1, 10))).select("event_id", "ts", "event_type")


@query("""SELECT event_id, sha256('event' || chr(31) || coalesce(nullif(lower(trim(regexp_replace(event_type, '\\s+', ' ', 'g'))), ''), chr(0)) || chr(31) || CAST(user_id AS DOUBLE)::VARCHAR) AS series_key FROM events""")
def series_key(spark, d):
    """The identity of a series; its number is the same text in both engines below ten million."""
    return table(spark, d, "events").select("event_id", values.series_key([(F.col("event_type"), "S"), (F.col("user_id"), "I")], "event").alias("series_key"))


def summary_branch(name: str, i: int, source: str, expression: str | None = None) -> str:
    x = expression or name
    return f"""SELECT {i} AS position, '{name}' AS field, CAST(count({x}) AS BIGINT) AS value_count, CAST(count(*) - count({x}) AS BIGINT) AS missing_count,
 round((count(*) - count({x})) / CAST(count(*) AS DOUBLE), 6) AS missing_fraction, round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg({x}), 6) AS mean FROM {source}"""


@query(" UNION ALL ".join(summary_branch(m, i, "lineitem", "CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END" if m == "l_tax" else None) for i, m in enumerate(MEASURES)))
def metric_summaries(spark, d):
    """Values that aren't finite (here: taxes made NaN) are missing."""
    df = table(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") > 0.07, float("nan")).otherwise(F.col("l_tax")))
    return profile.metric_summaries(df, MEASURES).select("position", "field", "value_count", "missing_count", *r6("missing_fraction", "min", "max", "mean"))


@query(f"""SELECT l_returnflag, l_linestatus, {STATS_SQL} FROM (SELECT l_returnflag, l_linestatus, l_extendedprice AS value FROM lineitem) GROUP BY 1, 2""")
def metric_stats_by_group(spark, d):
    out = profile.metric_stats(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "row_count", "value_count", "missing_count", *r6("missing_fraction", *STATS))


@query(f"WITH {EVENTS_SQL} " + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS field, CAST(sum(CASE WHEN {n} IS NULL{f" OR {n} = ''" if n != 'value' else ''} THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, round(avg(CASE WHEN {n} IS NULL{f" OR {n} = ''" if n != 'value' else ''} THEN 1.0 ELSE 0.0 END), 6) AS missing_fraction FROM e" for i, n in enumerate(EVENTS.important_fields)))
def missingness(spark, d):
    return profile.missingness(events(spark, d), list(EVENTS.important_fields)).select("position", "field", "missing_count", *r6("missing_fraction"))


@query(f"""WITH {EVENTS_SQL} SELECT 'events' AS dataset, 'raw' AS view, CAST(count(*) AS BIGINT) AS row_count FROM e UNION ALL SELECT 'events', 'exact', CAST(count(DISTINCT exact_key) AS BIGINT) FROM e UNION ALL SELECT 'events', 'series', CAST(count(DISTINCT series_key) AS BIGINT) FROM e""")
def overview(spark, d):
    return profile.overview(events(spark, d), EVENTS)


@query("SELECT CAST(count(*) AS BIGINT) AS row_count, min(ts) AS first_created_at, max(ts) AS last_created_at FROM events WHERE event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2020-01-01' AND ts <= TIMESTAMP '2030-01-01'")
def view_summary(spark, d):
    return profile.view_summary(apply_filters(events(spark, d), EVENTS, ObservationFilters(manufacturers=TYPES, created_from=FROM, created_to=TO)), EVENTS)


@query("SELECT source AS value, CAST(count(*) AS BIGINT) AS count FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark, d):
    return profile.top_values(documents(spark, d), "source", 10)


@query("SELECT key, CAST(count(*) AS BIGINT) AS row_count FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def extra_key_counts(spark, d):
    return profile.extra_key_counts(events(spark, d), "props")


@query("WITH k AS (SELECT json_keys(props) AS k FROM events), u AS (SELECT unnest(k) AS x FROM k) SELECT (SELECT CAST(count(*) AS BIGINT) FROM k WHERE len(k) > 0) AS nonempty_row_count, (SELECT CAST(count(DISTINCT x) AS BIGINT) FROM u) AS distinct_key_count")
def extra_key_totals(spark, d):
    return profile.extra_key_totals(events(spark, d), "props")


GROUPS_SQL = f"WITH {DOCUMENTS_SQL}, g AS (SELECT exact_key AS group_key, count(*) AS group_size, min(n_chars) AS first_created_at, max(n_chars) AS last_created_at FROM d GROUP BY 1 HAVING count(*) > 1)"


@query(f"{GROUPS_SQL} SELECT group_key, CAST(group_size AS BIGINT) AS group_size, first_created_at, last_created_at FROM g")
def duplicate_groups(spark, d):
    return duplicates.groups(documents(spark, d), DOCUMENTS, "exact")


@query(f"{GROUPS_SQL} SELECT group_key, CAST(group_size AS BIGINT) AS group_size, first_created_at, last_created_at FROM g ORDER BY g.group_size DESC, group_key LIMIT 10")
def duplicate_top_groups(spark, d):
    return duplicates.top_groups(duplicates.groups(documents(spark, d), DOCUMENTS, "exact"), 10)


@query(f"{GROUPS_SQL} SELECT CAST(group_size AS BIGINT) AS group_size, CAST(count(*) AS BIGINT) AS group_count FROM g GROUP BY 1")
def duplicate_histogram(spark, d):
    return duplicates.size_histogram(duplicates.groups(documents(spark, d), DOCUMENTS, "exact"))


@query(f"{GROUPS_SQL} SELECT CAST(count(*) AS BIGINT) AS duplicate_group_count, CAST(coalesce(sum(group_size), 0) AS BIGINT) AS duplicate_row_count FROM g")
def duplicate_totals(spark, d):
    return duplicates.totals(duplicates.groups(documents(spark, d), DOCUMENTS, "exact"))


@query(f"""{GROUPS_SQL}, t AS (SELECT * FROM g ORDER BY group_size DESC, group_key LIMIT 10) SELECT group_key, CAST(group_size AS BIGINT) AS group_size, CAST(member AS INTEGER) AS member, doc_id, lang, n_chars FROM
(SELECT t.group_key, t.group_size, d.*, row_number() OVER (PARTITION BY t.group_key ORDER BY n_chars DESC NULLS LAST, doc_id DESC) AS member FROM d JOIN t ON d.exact_key = t.group_key) WHERE member <= 5""")
def duplicate_samples(spark, d):
    return duplicates.samples(documents(spark, d), DOCUMENTS, "exact")


def head_sql(part: str, i: int, field: str, known: str, distinct: str = "0", number: str = "CAST(NULL AS DOUBLE)", time: str = "CAST(NULL AS TIMESTAMP)") -> str:
    return f"""SELECT '{part}' AS part, CAST({i} AS INTEGER) AS position, '{field}' AS field, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS row_count,
 CAST({known} AS BIGINT) AS known_count, CAST({distinct} AS BIGINT) AS distinct_count, round(min({number}), 6) AS min, round(max({number}), 6) AS max, round(avg({number}), 6) AS mean, min({time}) AS first_at, max({time}) AS last_at FROM s"""


def ranked_sql(part: str, field: str, counts: str, known: str, limit: int) -> str:
    return f"""SELECT '{part}', 0, '{field}', CAST(row_number() OVER (ORDER BY c DESC, v) AS INTEGER) AS rank, v, CAST(c AS BIGINT), CAST({known} AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL FROM ({counts}) QUALIFY rank <= {limit}"""


PROFILE_SQL = " UNION ALL ".join([
    head_sql("view", 0, "events", "count(*)", time="ts"),
    *(head_sql("missing", i, n, f"count({n})" if n == "value" else f"count(nullif({n}, ''))") for i, n in enumerate(EVENTS.important_fields)),
    *(head_sql("metric", i, n, f"count({n})", number=n) for i, n in enumerate(EVENTS.metric_fields)),
    head_sql("category", 0, "event_type", "count(nullif(event_type, ''))", "count(DISTINCT nullif(event_type, ''))"),
    head_sql("extra", 0, "props", "count(*) FILTER (len(json_keys(props)) > 0)", "(SELECT count(DISTINCT x) FROM (SELECT unnest(json_keys(props)) AS x FROM s))"),
    ranked_sql("category", "event_type", "SELECT event_type AS v, count(*) AS c FROM s WHERE event_type <> '' GROUP BY 1", "c", 10),
    ranked_sql("extra", "props", "SELECT v, count(*) AS c FROM (SELECT unnest(json_keys(props)) AS v FROM s) GROUP BY 1", "0", 25),
])


@query(f"{SERIES_SQL} {PROFILE_SQL}")
def modality_profile(spark, d):
    """Counts, missingness, metrics, top values and keys of the series view by one scan."""
    found = profile.whole(views.view(events(spark, d), EVENTS, "series"), EVENTS)
    return found.select("part", "position", "field", "rank", "value", "row_count", "known_count", "distinct_count", *r6("min", "max", "mean"), "first_at", "last_at")


def bundle_sql(kind: str, key: str) -> str:
    found = f"(SELECT coalesce({key}, CAST(event_id AS VARCHAR)) AS k, count(*) AS n, min(ts) AS a, max(ts) AS z FROM e GROUP BY 1)"
    return f"""SELECT '{kind}' AS kind, 'size' AS part, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS group_key, CAST(n AS BIGINT) AS group_size, CAST(count(*) AS BIGINT) AS group_count, min(a) AS first_created_at, max(z) AS last_created_at FROM {found} GROUP BY n
UNION ALL SELECT '{kind}', 'group', CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS rank, k, CAST(n AS BIGINT), NULL, a, z FROM {found} WHERE n > 1 QUALIFY rank <= 10"""


@query(f"WITH {EVENTS_SQL} {bundle_sql('exact', 'exact_key')} UNION ALL {bundle_sql('series', 'series_key')}")
def duplicate_bundle(spark, d):
    """Sizes and largest groups of both kinds by one scan."""
    return duplicates.bundle(events(spark, d), EVENTS)


def source_and_target(spark, d) -> tuple[DataFrame, DataFrame]:
    base = table(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
    return base.where("event_id % 5 < 3").withColumn("user_id", F.col("user_id") + 1).withColumn("event_type", F.lit("new")), base.where("event_id % 5 > 1")


MERGE_SQL = "WITH base AS (SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events), src AS (SELECT event_id, user_id + 1 AS user_id, 'new' AS event_type, value FROM base WHERE event_id % 5 < 3), tgt AS (SELECT * FROM base WHERE event_id % 5 > 1)"


@query(f"{MERGE_SQL} SELECT s.event_id, coalesce(t.user_id, CAST(NULL AS BIGINT)) AS user_id, s.event_type, s.value FROM src s LEFT JOIN tgt t USING (event_id) UNION ALL SELECT * FROM tgt WHERE event_id NOT IN (SELECT event_id FROM src)")
def upsert(spark, d):
    """New rows take the place of old ones, of which user_id is kept (rows new to the target have none)."""
    src, tgt = source_and_target(spark, d)
    return merge.upsert(tgt, src.drop("user_id"), "event_id", ["user_id"])


@query(f"{MERGE_SQL} SELECT * FROM tgt UNION ALL SELECT * FROM src WHERE event_id NOT IN (SELECT event_id FROM tgt)")
def insert_or_skip(spark, d):
    src, tgt = source_and_target(spark, d)
    return merge.insert_or_skip(tgt, src, "event_id")


@query(f"{MERGE_SQL} SELECT event_id FROM src WHERE event_id IN (SELECT event_id FROM tgt)")
def existing_ids(spark, d):
    src, tgt = source_and_target(spark, d)
    return merge.existing(src.select("event_id"), tgt, "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_of_batch(spark, d):
    return merge.one_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"], True).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_of_batch(spark, d):
    return merge.one_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"], False).select("user_id", "event_id", "event_type")


@query("SELECT event_id, CAST(event_type AS VARCHAR) AS event_type, CAST(NULL AS DOUBLE) AS weight FROM events")
def conform(spark, d):
    from pyspark.sql import types as T

    return merge.conform(table(spark, d, "events"), T.StructType.fromDDL("event_id long, event_type string, weight double"))


PATHS = "concat('dump-', cast(event_id % 3 as varchar(9)), '.json', case when event_id % 4 = 0 then '' else concat('#item=', cast(event_id as varchar(9))) end)"


@query(f"SELECT coalesce(max(CAST(nullif(regexp_extract(p, '#item=([0-9]+)$', 1), '') AS INTEGER)), 0) AS last_item FROM (SELECT {PATHS} AS p FROM events) WHERE starts_with(p, 'dump-1.json#item=')")
def resume_index(spark, d):
    return merge.resume_index(table(spark, d, "events").select(F.expr(PATHS).alias("p")), "dump-1.json", "p")


OLD_SQL = SERIES_SQL + HISTOGRAM_SQL.replace("SELECT CAST(i AS INTEGER)", ", old AS (SELECT CAST(i AS INTEGER)").replace("round(mn + i * w, 6)", "mn + i * w").replace("round(CASE WHEN i = 19 THEN mx ELSE mn + (i + 1) * w END, 6)", "CASE WHEN i = 19 THEN mx ELSE mn + (i + 1) * w END") + ")"
OLD_SQL = OLD_SQL.replace("GROUP BY 1)\n, old", "GROUP BY 1), old")
NEW_SQL = ", new AS (SELECT CAST(j AS INTEGER) AS bin, -50.0 + j * 50.0 AS a, CASE WHEN j = 11 THEN 550.0 ELSE -50.0 + (j + 1) * 50.0 END AS z FROM (SELECT unnest(range(0, 12)) AS j))"


def new_edges(spark: SparkSession) -> DataFrame:
    edges = compare.bucket_edges(-50.0, 550.0, 12)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, start double, end double")


@query(f"""{OLD_SQL}{NEW_SQL} SELECT n.bin, CAST(n.a AS DOUBLE) AS start, CAST(n.z AS DOUBLE) AS "end", round(coalesce(sum(o.count * (least(o."end", n.z) - greatest(o.start, n.a)) / (o."end" - o.start)), 0), 6) AS count
FROM new n LEFT JOIN old o ON least(o."end", n.z) > greatest(o.start, n.a) GROUP BY 1, 2, 3""")
def rebin_histogram(spark, d):
    old = profile.histogram(views.view(events(spark, d), EVENTS, "series"), "value", 20)
    return compare.rebinned(old, new_edges(spark)).select("bin", "start", "end", *r6("count"))


def two_histograms(spark, d) -> DataFrame:
    df = events(spark, d)
    parts = {}
    for name in ("click", "purchase"):
        one = df.where(F.col("event_type") == name)
        n = one.where(values.finite(F.col("value"))).count()
        parts[name] = compare.probabilities(compare.rebinned(profile.histogram(one, "value", 10), new_edges(spark)), n)
    return compare.merged(parts)


def side_sql(name: str) -> str:
    return f"""v_{name} AS (SELECT value FROM events WHERE event_type = '{name}' AND value IS NOT NULL), b_{name} AS (SELECT min(value) AS mn, max(value) AS mx, count(*) AS n FROM v_{name}),
o_{name} AS (SELECT i, mn + i * (mx - mn) / 10 AS s, CASE WHEN i = 9 THEN mx ELSE mn + (i + 1) * (mx - mn) / 10 END AS e, (SELECT count(*) FROM v_{name} WHERE least(CAST(floor((value - mn) / ((mx - mn) / 10)) AS INTEGER), 9) = i) AS c, n FROM b_{name} CROSS JOIN (SELECT unnest(range(0, 10)) AS i)),
p_{name} AS (SELECT bin, coalesce(sum(c * (least(e, z) - greatest(s, a)) / (e - s) / n), 0) AS p FROM new LEFT JOIN o_{name} ON least(e, z) > greatest(s, a) GROUP BY 1)"""


@query(f"WITH {NEW_SQL[2:]}, {side_sql('click')}, {side_sql('purchase')} SELECT p_click.bin, round(p_click.p, 6) AS click, round(p_purchase.p, 6) AS purchase FROM p_click JOIN p_purchase USING (bin)")
def compared_histograms(spark, d):
    """Two populations on common bins as probabilities."""
    return two_histograms(spark, d).select("bin", *r6("click", "purchase"))


@query("""SELECT page, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM (
SELECT unnest(range(1, 6)) AS page, 'early' AS reason UNION ALL SELECT unnest(range(62, 65)), 'tail' UNION ALL SELECT unnest([1, 2, 64]), 'probe'
UNION ALL SELECT DISTINCT 1 + CAST(round_even(63.0 * i / 9.0, 0) AS BIGINT), 'linear' FROM (SELECT unnest(range(0, 10)) AS i)) GROUP BY 1""")
def page_plan(spark, d):
    frontier = paging.Frontier(64, [paging.Probe(1, 5), paging.Probe(2, 5), paging.Probe(64, 5)])
    return paging.plan_pages(spark, frontier, 10).select(F.col("page").cast("long"), F.array_join("reasons", ",").alias("reasons"))


@query("SELECT DISTINCT CAST(1 + round_even(99.0 * i / 4.0, 0) AS INTEGER) AS page FROM (SELECT unnest(range(0, 5)) AS i)")
def evenly_spaced_pages(spark, d):
    return paging.evenly_spaced(spark, 1, 100, 5)


def pages(spark, d) -> DataFrame:
    """Pages of ten events each, in the form of the API."""
    item = F.struct(
        F.col("event_id").cast("string").alias("_id"), F.col("ts").cast("string").alias("_created"),
        F.struct(F.col("event_type").alias("task_id"), F.col("user_id").cast("string").alias("subject_id"), F.expr("nullif(event_type, 'error')").alias("Manufacturer")).alias("bids_meta"), F.struct(F.md5(F.col("props").cast("binary")).alias("md5sum"), F.lit("1.0").alias("version")).alias("provenance"),
    )
    rows = table(spark, d, "events").select(F.expr("cast(event_id div 10 as int)").alias("page"), "event_id", item.alias("item"))
    rows = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]).alias("_items"))
    return rows.select("page", F.to_json(F.struct("_items")).alias("value"))


def items(spark, d) -> DataFrame:
    found = pages(spark, d).select("page", F.posexplode(page_items(F.col("value"))).alias("i", "value"))
    return found.select("value", F.col("page").alias("source_page"), (F.col("i") + 1).cast("long").alias("item_index"))


ITEMS_SQL = "WITH i AS (SELECT CAST(event_id // 10 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) AS BIGINT) AS item_index, CAST(event_id AS VARCHAR) AS item_id, event_type, CAST(user_id AS VARCHAR) AS subject_id, md5(props) AS md5 FROM events)"


@query(f"{ITEMS_SQL} SELECT page, item_index, item_id, md5, subject_id, CAST(4 AS INTEGER) AS key_count, CASE WHEN event_type = 'error' THEN 'bids_meta.Manufacturer,bids_meta.run_id' ELSE 'bids_meta.run_id' END AS missing FROM i")
def page_item_manifest(spark, d):
    out = item_manifest(items(spark, d), ["bids_meta.Manufacturer", "bids_meta.run_id", "bids_meta.task_id"])
    return out.select("page", "item_index", "item_id", "md5", "subject_id", "key_count", F.array_join("missing", ",").alias("missing"))


@query(f"""{ITEMS_SQL}, m AS (SELECT page, count(*) AS n FROM (SELECT page, md5 FROM i GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1), s AS (SELECT page, count(*) AS n FROM (SELECT page, subject_id FROM i GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT i.page, CAST(count(*) AS BIGINT) AS item_count, CAST(coalesce(max(m.n), 0) AS BIGINT) AS md5_groups, CAST(coalesce(max(s.n), 0) AS BIGINT) AS subject_groups FROM i LEFT JOIN m USING (page) LEFT JOIN s USING (page) GROUP BY 1""")
def page_summaries(spark, d):
    return page_summary(pages(spark, d)).select("page", "item_count", "md5_groups", "subject_groups")


@query(f"{ITEMS_SQL} SELECT event_type AS value, CAST(count(*) AS BIGINT) AS count FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def sample_tasks(spark, d):
    return sample_summary(items(spark, d), ["bids_meta.Manufacturer"])["tasks"]


@query(f"{ITEMS_SQL} SELECT 'bids_meta.Manufacturer' AS key, CAST(count(*) AS BIGINT) AS count FROM i WHERE event_type = 'error' HAVING count(*) > 0 UNION ALL SELECT 'bids_meta.run_id', CAST(count(*) AS BIGINT) FROM i HAVING count(*) > 0")
def sample_missing(spark, d):
    gone = items(spark, d).select(F.explode(missing_of(F.col("value"), ["bids_meta.Manufacturer", "bids_meta.run_id"])).alias("key"))
    return gone.groupBy("key").agg(F.count(F.lit(1)).alias("count"))


def report(spark, d) -> DataFrame:
    """Line items as a CSV report would have them: all texts, some of them blank or no numbers."""
    odd = "CASE WHEN l_orderkey % 11 = 0 THEN ' ' WHEN l_orderkey % 13 = 0 THEN '0x10' WHEN l_orderkey % 17 = 0 THEN 'NaN' WHEN l_orderkey % 19 = 0 THEN '1d' ELSE concat(' ', cast(cast(l_quantity as int) as string), ' ') END"
    return table(spark, d, "lineitem").select(F.expr(odd).alias("efc"), F.expr("cast(cast(l_quantity as int) as string)").alias("fd_mean"))


REPORT_SQL = "CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 13 = 0 OR l_orderkey % 17 = 0 OR l_orderkey % 19 = 0 THEN NULL ELSE floor(l_quantity) END"


@query(f"""WITH lineitem_ AS (SELECT {REPORT_SQL} AS efc, floor(l_quantity) AS fd_mean, CAST(NULL AS DOUBLE) AS tsnr FROM lineitem) {summary_branch('efc', 0, 'lineitem_')} UNION ALL {summary_branch('fd_mean', 1, 'lineitem_')} UNION ALL {summary_branch('tsnr', 2, 'lineitem_')}""")
def report_summary(spark, d):
    out = compare.report_summary(report(spark, d), ["efc", "fd_mean", "tsnr"])
    return out.select("position", "field", "value_count", "missing_count", *r6("missing_fraction", "min", "max", "mean"))


@query(f"""WITH s AS (SELECT value FROM (SELECT {REPORT_SQL} AS value FROM lineitem) WHERE value IS NOT NULL), b AS (SELECT min(value) AS mn, max(value) AS mx, CAST(least(24, greatest(1, floor(sqrt(count(*)) + 0.5))) AS INTEGER) AS n FROM s),
w AS (SELECT mn, mx, n, (mx - mn) / n AS w FROM b), h AS (SELECT least(CAST(floor((value - mn) / w) AS INTEGER), n - 1) AS bin, count(*) AS c FROM s CROSS JOIN w GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(mn + i * w, 6) AS start, round(CASE WHEN i = n - 1 THEN mx ELSE mn + (i + 1) * w END, 6) AS "end", CAST(coalesce(c, 0) AS BIGINT) AS count FROM w CROSS JOIN (SELECT unnest(range(0, 24)) AS i) LEFT JOIN h ON h.bin = i WHERE i < n""")
def report_histogram(spark, d):
    return compare.report_histogram(report(spark, d), "efc").select("bin", *r6("start", "end"), "count")


@query("")
def metric_catalog(spark, d):
    return labels.catalog(spark, "bold")


@query("")
def metric_catalog_by_category(spark, d):
    return compare.by_category(labels.catalog(spark, "T1w"))


@query("")
def metric_search(spark, d):
    return labels.search(spark, "bold", "frame disp")


@query("""SELECT n_regionkey AS family, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS subfamily, array_to_string(list_sort(list(n_name)), ',') AS fields FROM nation GROUP BY 1, 2""")
def grouped_catalog(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("family"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("subfamily"), F.col("n_name").alias("label"), F.col("n_name").alias("field"))
    return compare.by_category(rows).select("family", "subfamily", F.array_join("fields", ",").alias("fields"))


@query("""WITH v AS (SELECT event_type AS field, count(value) AS value_count, count(*) - count(value) AS missing_count FROM events GROUP BY 1), c(position, field) AS (VALUES (0, 'click'), (1, 'purchase'), (2, 'unknown'))
SELECT c.field, c.position, CAST(v.value_count AS BIGINT) AS value_count, round(CASE WHEN v.field IS NULL THEN NULL ELSE v.missing_count / CAST(v.missing_count + v.value_count AS DOUBLE) END, 6) AS missing_share FROM c LEFT JOIN v USING (field)""")
def metric_badges(spark, d):
    catalog = spark.createDataFrame([(0, "click"), (1, "purchase"), (2, "unknown")], "position int, field string")
    summaries = table(spark, d, "events").groupBy(F.col("event_type").alias("field")).agg(F.count("value").alias("value_count"), (F.count(F.lit(1)) - F.count("value")).alias("missing_count"))
    return compare.badges(catalog, summaries).select("field", "position", "value_count", *r6("missing_share"))


TEXTS = "CASE CAST(event_id % 8 AS INTEGER) WHEN 0 THEN '  A  B ' WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN '12.50' WHEN 5 THEN '-3e2' WHEN 6 THEN '0x1F' ELSE event_type END"


@query(f"SELECT event_id, nullif(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), '') AS identity, CASE WHEN t IN ('12.50', '-3e2') THEN CAST(t AS DOUBLE) END AS number, t IS NULL OR t = '' AS is_missing FROM (SELECT event_id, {TEXTS} AS t FROM events)")
def text_values(spark, d):
    """Identity texts, strict numbers and missing values."""
    t = F.expr(TEXTS)
    return table(spark, d, "events").select("event_id", values.identity_text(t).alias("identity"), values.strict_number(t).alias("number"), values.missing(t).alias("is_missing"))


@query("SELECT event_id, value AS finite FROM (SELECT event_id, CASE WHEN event_id % 4 < 3 THEN NULL ELSE round(value, 6) END AS value FROM events)")
def finite_values(spark, d):
    """NaN, infinities and nulls are no values."""
    v = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).when(F.col("event_id") % 4 == 2, None).otherwise(F.round("value", 6))
    return table(spark, d, "events").select("event_id", values.finite_or_null(v).alias("finite"))


@query("SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS http FROM events")
def parsed_times(spark, d):
    """Times from ISO 8601 and from HTTP dates."""
    ts = F.date_trunc("second", "ts")
    iso, http = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "E, dd MMM yyyy HH:mm:ss 'GMT'")
    utc = lambda c: F.to_timestamp_ntz(F.date_format(values.parse_datetime(c), "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", utc(iso).alias("iso"), utc(http).alias("http"))


@query("SELECT event_id, CAST(event_id % 1000 AS INTEGER) AS page, CAST(event_id AS INTEGER) AS item FROM events")
def path_numbers(spark, d):
    path = F.format_string("run/raw/T1w/page-%06d.json", F.col("event_id") % 1000)
    return table(spark, d, "events").select("event_id", values.page_number(path).alias("page"), values.item_number(F.concat(path, F.lit("#item="), F.col("event_id"))).alias("item"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_api_id, CAST(o_custkey AS VARCHAR) AS subject_id, o_orderstatus AS manufacturer, round(o_totalprice, 6) AS cjv, CAST(o_orderkey % 90 AS INTEGER) AS flip_angle, 'Extra,' || 'custom' AS extra_keys, CAST(3 AS INTEGER) AS lacking FROM orders")
def parsed_observations(spark, d):
    """Observations parsed from JSON: renamed, typed, with what has no column in the extras."""
    from .parse import missing_required, parse

    o = table(spark, d, "orders")
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("_id"), F.round("o_totalprice", 6).alias("cjv"), F.lit("x").alias("custom"),
        F.struct(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderstatus").alias("Manufacturer"), (F.col("o_orderkey") % 90).cast("double").alias("FlipAngle"), F.lit(1).alias("Extra")).alias("bids_meta"),
    )
    rows = parse(o.select(F.to_json(item).alias("value"), F.lit(None).cast("string").alias("raw_payload_path"), F.lit(None).cast("int").alias("source_page"), F.lit(1).cast("long").alias("item_index")), "T1w")
    keys = F.array_join(F.concat(F.map_keys("bids_meta_extra"), F.map_keys("payload_extra")), ",")
    lacking = F.size(F.array_intersect(missing_required(modality("T1w")), F.array(*[F.lit(c) for c in ("source_md5sum", "pipeline_version", "pipeline_software", "subject_id")])))
    return rows.select("source_api_id", "subject_id", "manufacturer", "cjv", "flip_angle", keys.alias("extra_keys"), lacking.alias("lacking"))


@query("WITH v AS (SELECT DISTINCT event_type AS k FROM events) SELECT k AS value, CAST((SELECT count(*) FROM events WHERE event_type = k) AS BIGINT) AS count FROM v ORDER BY 2 DESC, 1 LIMIT 24")
def filter_options(spark, d):
    """What a filter offers: the most frequent values of all rows."""
    return profile.top_values(events(spark, d), "event_type", compare.FILTER_OPTIONS)


# A table of events through three loads: those that aren't clicks; those that aren't purchases, by users one higher (an update keeps the user, its series key is of the new one); all, of which known ones are skipped.
LOADS_SQL = """a AS (SELECT event_id, ts, user_id, event_type, event_type <> 'click' AS one, event_type <> 'purchase' AS two FROM events),
 f AS (SELECT event_id, ts, event_type, CASE WHEN two AND NOT one THEN user_id + 1 ELSE user_id END AS user_id, CASE WHEN two THEN 'second' WHEN one THEN 'first' ELSE 'third' END AS note,
  CASE WHEN two THEN user_id + 1 ELSE user_id END || '|' || event_type AS series_key FROM a)"""
LOADED = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("event_type", "note", "exact_key", "series_key"))])


def loaded_events(spark: SparkSession, d: str) -> Tables:
    """The three loads, into a fresh store."""
    tables, rows = Tables(spark, new_shared_folder(spark, "loads")), table(spark, d, "events")
    key = lambda user: F.concat(user.cast("string"), F.lit("|"), F.col("event_type"))

    def load(note: str, kept: DataFrame, user: Column, last_wins: bool) -> None:
        own = kept.select("event_id", "ts", user.alias("user_id"), "event_type", F.lit(note).alias("note"), F.md5(F.col("props").cast("binary")).alias("exact_key"), key(user).alias("series_key"))
        tables.merge_rows(EVENTS, LOADED, own, last_wins=last_wins, keep=("user_id",))

    load("first", rows.where("event_type <> 'click'"), F.col("user_id"), True)
    load("second", rows.where("event_type <> 'purchase'"), F.col("user_id") + 1, True)
    load("third", rows, F.col("user_id"), False)
    return tables


@query(f"WITH {LOADS_SQL} SELECT event_id, user_id, event_type, note, series_key FROM f")
def loaded_rows(spark, d):
    return loaded_events(spark, d).pin().read("events", LOADED).select("event_id", "user_id", "event_type", "note", "series_key")


@query(f"WITH {LOADS_SQL} SELECT event_id, note, series_key FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(series_key, CAST(event_id AS VARCHAR)) ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM f) WHERE rn = 1")
def refreshed_series(spark, d):
    """The stored series view, which has followed load by load."""
    return loaded_events(spark, d).pin().read("events_series", LOADED).select("event_id", "note", "series_key")
