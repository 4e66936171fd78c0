"""Labels of metrics: names, families and units by rules over the field's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import modality

# ---- fixed values: words that keep a spelling of their own, families, subfamilies and units
WORDS = {
    "aor": "AFNI outlier ratio", "aqi": "AFNI quality index", "avg": "Average", "bg": "Background", "cjv": "Coefficient of joint variation", "cnr": "Contrast-to-noise ratio", "csf": "CSF", "dvars": "DVARS",
    "efc": "Entropy-focus criterion", "fber": "Foreground-background energy ratio", "fd": "Framewise displacement", "fg": "Foreground", "fwhm": "Full-width at half maximum", "gcor": "Global correlation",
    "gm": "Gray matter", "gsr": "Ghost-to-signal ratio", "icvs": "Intracranial volume fraction", "inu": "Intensity non-uniformity", "mad": "MAD", "nstd": "Standardized", "p05": "P05", "p95": "P95",
    "perc": "Percent", "qi": "Quality index", "rpve": "Residual partial volume error", "snr": "Signal-to-noise ratio", "snrd": "Dietrich SNR", "std": "Standard", "stdv": "Standard deviation",
    "tpm": "TPM overlap", "tr": "TR", "tsnr": "Temporal SNR", "vstd": "Voxelwise standardized", "wm": "White matter", "wm2max": "White-matter to max ratio",
}
FAMILIES = [
    ("fd_* dummy_trs", "Motion"), ("dvars* aor aqi gcor gsr_x gsr_y tsnr", "Temporal Stability"), ("fwhm* size_* spacing_*", "Resolution"), ("summary_*", "Tissue Summaries"),
    ("snr*", "Signal Quality"), ("icvs* rpve* tpm_overlap*", "Tissue Composition"), ("inu* cjv cnr efc fber qi_1 qi_2 wm2max", "Artifacts and Contrast"),
]
SUBFAMILIES = [
    ("fd_*", "Framewise displacement"), ("dummy_trs", "Pre-steady-state volumes"), ("dvars*", "DVARS"), ("aor aqi", "AFNI quality"), ("gcor gsr_x gsr_y", "Global signal"), ("tsnr", "Temporal SNR"),
    ("fwhm*", "Smoothness"), ("size_*", "Matrix size"), ("spacing_*", "Voxel spacing"), ("summary_bg_*", "Background"), ("summary_fg_*", "Foreground"), ("summary_csf_*", "CSF"),
    ("summary_gm_*", "Gray matter"), ("summary_wm_*", "White matter"), ("snrd_*", "Dietrich SNR"), ("snr_*", "Tissue SNR"), ("snr", "Overall SNR"), ("icvs_*", "Intracranial volume fractions"),
    ("rpve_*", "Partial volume error"), ("tpm_overlap_*", "TPM overlap"), ("inu_*", "Intensity non-uniformity"), ("qi_*", "Artifact detection"), ("cjv cnr efc fber wm2max", "Global quality"),
]
UNITS = [("spacing_*", "mm"), ("size_* dummy_trs fd_num", "count"), ("*_perc", "percent")]
# ---- end of fixed values


def fits(pattern: str, name: str) -> bool:
    if pattern.startswith("*"):
        return name.endswith(pattern[1:])
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern


def first_rule(rules: list[tuple[str, str]], name: str, otherwise):
    """What the first rule with a fitting pattern says."""
    return next((said for patterns, said in rules if any(fits(p, name) for p in patterns.split())), otherwise)


def label(name: str) -> str:
    """A field's name for people, part by part: known parts have a text of their own, single letters are upper case, others capitalised."""
    return " ".join(WORDS.get(w) or (w.upper() if len(w) == 1 else w.title()) for w in name.split("_"))


def family(name: str, dataset: str) -> str:
    found = first_rule(FAMILIES, name, "Other")
    return "Signal Summaries" if found == "Tissue Summaries" and dataset == "bold" else found


def subfamily(name: str) -> str:
    return first_rule(SUBFAMILIES, name, "Other")


def unit(name: str) -> str | None:
    return first_rule(UNITS, name, None)


def describe(name: str, dataset: str) -> str:
    """A sentence on a metric."""
    has = unit(name)
    return f"{label(name)}: {subfamily(name).lower() if subfamily(name) != 'Other' else family(name, dataset).lower()}" + (f", in {has}" if has else "") + "."


def catalog(spark: SparkSession, dataset: str) -> DataFrame:
    """(position, field, label, family, subfamily, unit) of a modality's metrics."""
    names = modality(dataset).metric_fields
    return spark.createDataFrame([(i, n, label(n), family(n, dataset), subfamily(n), unit(n)) for i, n in enumerate(names)], "position int, field string, label string, family string, subfamily string, unit string")


def search_score(text: str, wanted: str) -> int:
    """How well a text fits what is typed: 0 unless its letters occur in order. A letter counts 1, 2 more for each letter of the run it continues, 3 more at the start of a word; a substring counts 4 for each letter."""
    text, wanted = text.lower(), wanted.strip().lower()
    last, run, score = -1, 0, 0
    for c in wanted:
        found = text.find(c, last + 1)
        if found < 0:
            return 0
        run = run + 1 if found == last + 1 else 0
        score += 1 + 2 * run + 3 * (found == 0 or text[found - 1] in " _")
        last = found
    return score + 4 * len(wanted) * (wanted in text)


def search(spark: SparkSession, dataset: str, wanted: str) -> DataFrame:
    """The catalogue's metrics that fit, best first (equal ones in the catalogue's order); all of them for a blank search."""
    rows = catalog(spark, dataset)
    if not wanted.strip():
        return rows.orderBy("position")
    score = F.udf(lambda text: search_score(text, wanted), "int")  # a few dozen rows
    text = F.concat_ws(" ", "label", "field", "family", "subfamily")
    return rows.withColumn("score", score(text)).where("score > 0").orderBy(F.col("score").desc(), "position")
