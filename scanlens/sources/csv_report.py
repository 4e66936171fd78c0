"""Reports of a study's own: a CSV file with a column for each metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import MODALITIES

#: Columns that only functional reports have (fixed values).
BOLD_HINTS = ("fd_mean", "tsnr", "dvars_std", "gcor", "aor", "aqi")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts: quoted cells may hold commas, line feeds and doubled quotes; blank lines are left out; short rows are filled up with nulls. Only .csv files; a file without a row is an error."""
    if not path.lower().endswith(".csv"):
        raise ValueError(f"{path} is not a CSV file")
    report = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if not report.columns or report.isEmpty():
        raise ValueError(f"{path} has no rows")
    return report


def infer_modality(name: str, headers: list[str]) -> str | None:
    """The modality that a file's name says, else bold for a header that only it has, else None: then the user says it."""
    found = next((m for m in MODALITIES if m.lower() in name.lower()), None)
    return found or ("bold" if set(BOLD_HINTS) & set(headers) else None)


def finalize(drafts: list[tuple[str, str | None, DataFrame]]) -> dict[str, DataFrame]:
    """Reports by modality from (name, modality, report); every report needs a modality, a later one of the same modality takes the place of an earlier one."""
    for name, modality, _ in drafts:
        if modality not in MODALITIES:
            raise ValueError(f"{name}: which modality is it?")
    return {modality: report for _, modality, report in drafts}
