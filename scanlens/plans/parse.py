"""From an observation's JSON to a row of its modality's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import parse_datetime, series_key, snake, whole_number
from ..spec import DatasetSpec, modality

#: Where the columns that have names of their own come from.
PROVENANCE = {"md5sum": "source_md5sum", "version": "pipeline_version", "software": "pipeline_software", "email": "provenance_email"}
SETTINGS = {"fd_thres": "settings_fd_thres", "hmc_fsl": "settings_hmc_fsl", "testing": "settings_testing"}
RATING = {"rating": "rating_label", "name": "rating_name", "comment": "rating_comment", "md5sum": "rating_md5sum"}
META = {"_id": "source_api_id", "_etag": "source_etag", "_created": "source_created_at", "_updated": "source_updated_at"}
IDENTITY = ("modality", "subject_id", "session_id", "run_id", "acq_id", "task_id")
#: The key in provenance that holds a prediction ends so.
PREDICTION = "_pred"


def cast(text: Column, kind: str) -> Column:
    """A JSON value (as text) in a column's type."""
    if kind == "D":
        return text.try_cast("double")
    if kind == "I":
        return whole_number(text)
    if kind == "B":
        return text.try_cast("boolean")
    if kind == "T":
        millis = F.timestamp_millis(F.get_json_object(text, "$['$date']").try_cast("bigint"))
        return F.coalesce(parse_datetime(text), millis)
    return text


def json_map(text: Column) -> Column:
    """An object's members as JSON texts (strings without quotes); empty for anything but an object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def without(members: Column, keys) -> Column:
    keys = list(keys)
    return F.map_filter(members, lambda k, _: ~k.isin(*keys)) if keys else members


def is_known_bids(spec: DatasetSpec):
    """Whether a key of bids_meta has a column: identity keys by their own name, others by the name in snake case."""
    names = [n for n, _, _ in spec.schema]
    known = [n for n in names if n not in IDENTITY and not n.startswith(("source_", "pipeline_", "settings_", "rating_", "provenance_", "dedupe_"))]
    return lambda k: k.isin(*IDENTITY) | (k.rlike("^[A-Z]") & snake(k).isin(*known))


def parse(items: DataFrame, name: str) -> DataFrame:
    """items (value, raw_payload_path, source_page, item_index) as rows of modality `name`, with item_index and no id and inserted_at yet.

    Members without a column are kept in the extras of their object, except for a structural item's rating,
    which is not kept. The item's own modality, if it has one, is the row's; keys use `name`.
    """
    spec = modality(name)
    kinds = {n: k for n, k, _ in spec.schema}
    columns = set(kinds)
    known = is_known_bids(spec)
    rows = items.withColumn("top", json_map(F.col("value")))
    rows = rows.withColumn("bids", json_map(F.col("top")["bids_meta"])).withColumn("prov", json_map(F.col("top")["provenance"]))
    rows = rows.withColumn("settings", json_map(F.col("prov")["settings"])).withColumn("rate", json_map(F.col("top")["rating"]))
    rows = rows.withColumn("named", F.transform_keys(F.map_filter("bids", lambda k, _: known(k)), lambda k, _: snake(k)))
    out: dict[str, Column] = {}
    for source, keys in (("top", META), ("prov", PROVENANCE), ("settings", SETTINGS), ("rate", RATING if "rating_label" in columns else {})):
        out |= {c: cast(F.col(source)[k], kinds[c]) for k, c in keys.items()}
    prediction = F.get(F.map_values(F.map_filter("prov", lambda k, _: k.endswith(PREDICTION))), F.lit(0))
    out["pipeline_pred"] = whole_number(prediction)
    out |= {m: cast(F.col("top")[m], kinds[m]) for m in spec.metric_fields}
    out |= {n: cast(F.col("named")[n], kinds[n]) for n in columns if n not in out and n not in ("modality", "id", "inserted_at") and not n.endswith("_extra") and not n.startswith(("dedupe_", "canonical_", "raw_", "source_"))}
    out["modality"] = F.coalesce(F.col("named")["modality"], F.lit(name))
    out["payload_extra"] = without(F.col("top"), [*META, "bids_meta", "provenance", "rating", *spec.metric_fields])
    out["bids_meta_extra"] = F.map_filter("bids", lambda k, _: ~known(k))
    out["provenance_extra"] = F.map_filter(without(F.col("prov"), [*PROVENANCE, "settings"]), lambda k, _: ~k.endswith(PREDICTION))
    out["provenance_settings_extra"] = without(F.col("settings"), SETTINGS)
    if "rating_extra" in columns:
        out["rating_extra"] = without(F.col("rate"), RATING)
    out |= {"raw_payload_path": F.col("raw_payload_path"), "source_page": F.col("source_page"), "dedupe_exact_key": out["source_md5sum"], "dedupe_status": F.lit("pending"), "canonical_source_api_id": F.lit(None).cast("string")}
    rows = rows.select("item_index", *[c.alias(n) for n, c in out.items()])
    rows = rows.withColumn("dedupe_series_key", series_key([(F.col(n), kinds[n]) for n in spec.series_fields], name))
    return rows.select("item_index", *[n for n, _, _ in spec.schema if n not in ("id", "inserted_at")])


def missing_required(spec: DatasetSpec) -> Column:
    """The required columns that a row lacks."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in spec.required]))


def validated(rows: DataFrame, spec: DatasetSpec, *, quarantine: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows that have all required columns. A row that lacks one fails the job, or, with quarantine, is in the second table with the names it lacks."""
    marked = rows.withColumn("__missing", missing_required(spec))
    good, bad = F.size("__missing") == 0, F.size("__missing") > 0
    if quarantine:
        return marked.where(good).drop("__missing"), marked.where(bad).select("source_api_id", "raw_payload_path", "item_index", F.col("__missing").alias("missing"))
    told = F.concat(F.lit("missing required columns: "), F.array_join("__missing", ", "), F.lit(" in "), F.coalesce("raw_payload_path", F.lit("?")))
    return marked.where(F.when(good, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("__missing"), None
