"""What a dataset is: its columns, keys, filters and the fields that are profiled.

An observation is one row of quality metrics of a scan. Three modalities have tables of their own; any other
table is profiled in the same way through a DatasetSpec.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import types as T

KINDS = {"D": T.DoubleType(), "I": T.IntegerType(), "L": T.LongType(), "S": T.StringType(), "B": T.BooleanType(), "T": T.TimestampType(), "J": T.MapType(T.StringType(), T.StringType())}


def columns(text: str) -> list[tuple[str, str, bool]]:
    """'name:kind' or 'name:kind?' (nullable), separated by blanks, as (name, kind, nullable)."""
    return [(name, kind[0], kind.endswith("?")) for name, kind in (x.split(":") for x in text.split())]


# ---- fixed values: the columns of an observation table, by origin
SOURCE = columns(
    "id:L source_api_id:S source_page:I? source_etag:S? source_created_at:T? source_updated_at:T? raw_payload_path:S? source_md5sum:S pipeline_version:S pipeline_software:S pipeline_pred:I? "
    "provenance_email:S? settings_fd_thres:D? settings_hmc_fsl:B? settings_testing:B? provenance_settings_extra:J provenance_extra:J payload_extra:J "
    "dedupe_exact_key:S? dedupe_series_key:S? dedupe_status:S canonical_source_api_id:S? inserted_at:T"
)
IDENTITY = columns("subject_id:S session_id:S? run_id:S? acq_id:S? task_id:S?")
ACQUISITION = columns(
    "accel_num_reference_lines:I? acceleration_factor_pe:I? acquisition_matrix:S? cog_atlas_id:S? cog_poid:S? coil_combination_method:S? contrast_bolus_ingredient:S? conversion_software:S? "
    "conversion_software_version:S? delay_time:D? device_serial_number:S? echo_time:D? echo_train_length:I? effective_echo_spacing:D? flip_angle:I? gradient_set_type:S? "
    "hardcopy_device_software_version:S? imaging_frequency:I? in_plane_phase_encoding_direction:S? institution_address:S? institution_name:S? instructions:S? inversion_time:D? "
    "mr_acquisition_type:S? mr_transmit_coil_sequence:S? magnetic_field_strength:D? manufacturer:S? manufacturers_model_name:S? matrix_coil_mode:S? multiband_acceleration_factor:D? "
    "number_of_averages:I? number_of_phase_encoding_steps:I? number_of_volumes_discarded_by_scanner:D? number_of_volumes_discarded_by_user:D? number_shots:I? parallel_acquisition_technique:S? "
    "parallel_reduction_factor_in_plane:D? partial_fourier:B? partial_fourier_direction:S? patient_position:S? percent_phase_field_of_view:I? percent_sampling:I? phase_encoding_direction:S? "
    "pixel_bandwidth:I? protocol_name:S? pulse_sequence_details:S? pulse_sequence_type:S? receive_coil_name:S? repetition_time:D? scan_options:S? scanning_sequence:S? sequence_name:S? "
    "sequence_variant:S? slice_encoding_direction:S? software_versions:S? task_description:S? total_readout_time:D? total_scan_time_sec:I? transmit_coil_name:S? variable_flip_angle_flag:S?"
)
RATING = columns("task_name:S? rating_label:S? rating_name:S? rating_comment:S? rating_md5sum:S? rating_extra:J")


def tissue(parts: str, nullable: str = "") -> list[tuple[str, str, bool]]:
    """The summaries of each tissue."""
    return [(f"summary_{p}_{s}", "D", s in nullable.split()) for p, s in product(parts.split(), "k mean median mad p05 p95 stdv n".split())]


STRUCTURAL = [
    *columns("cjv:D cnr:D efc:D fber:D fwhm_avg:D fwhm_x:D fwhm_y:D fwhm_z:D icvs_csf:D icvs_gm:D icvs_wm:D inu_med:D inu_range:D qi_1:D qi_2:D rpve_csf:D rpve_gm:D rpve_wm:D size_x:I size_y:I size_z:I"),
    *columns("snr_csf:D snr_gm:D snr_total:D snr_wm:D snrd_csf:D snrd_gm:D snrd_total:D snrd_wm:D spacing_x:D spacing_y:D spacing_z:D"),
    *tissue("bg csf gm wm", "median mad n"),
    *columns("tpm_overlap_csf:D tpm_overlap_gm:D tpm_overlap_wm:D wm2max:D"),
]
BOLD = [
    *columns("aor:D aqi:D dummy_trs:I? dvars_nstd:D dvars_std:D dvars_vstd:D efc:D fber:D fd_mean:D fd_num:D fd_perc:D fwhm_avg:D fwhm_x:D fwhm_y:D fwhm_z:D gcor:D gsr_x:D gsr_y:D"),
    *columns("size_t:D size_x:D size_y:D size_z:D snr:D spacing_tr:D spacing_x:D spacing_y:D spacing_z:D"),
    *tissue("bg fg"),
    *columns("tsnr:D"),
]
SCANNER = "manufacturer manufacturers_model_name magnetic_field_strength echo_time repetition_time".split()
STRUCTURAL_SERIES = ["subject_id", "session_id", "run_id", "acq_id", *SCANNER, "inversion_time", "flip_angle", *(f"{a}_{b}" for a, b in product(("size", "spacing"), "xyz"))]
BOLD_SERIES = ["subject_id", "session_id", "run_id", "acq_id", "task_id", "task_name", *SCANNER, "flip_angle", *(f"size_{x}" for x in "txyz"), "spacing_tr", *(f"spacing_{x}" for x in "xyz")]
SAMPLES = "source_api_id source_created_at subject_id session_id run_id acq_id task_id task_name manufacturer manufacturers_model_name pipeline_version".split()
# ---- end of fixed values


@dataclass(frozen=True)
class DatasetSpec:
    """Names of a dataset's columns by the part they play."""

    name: str
    id_col: str
    time_col: str
    tie_col: str
    exact_key: str
    series_key: str
    filters: dict[str, str] = field(default_factory=dict)
    category_fields: tuple[str, ...] = ()
    metric_fields: tuple[str, ...] = ()
    important_fields: tuple[str, ...] = ()
    extra_fields: tuple[str, ...] = ()
    sample_fields: tuple[str, ...] = ()
    series_fields: tuple[str, ...] = ()
    schema: tuple[tuple[str, str, bool], ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, KINDS[k]) for n, k, _ in self.schema])

    @property
    def required(self) -> list[str]:
        """Columns that an observation must have: not nullable and not filled in by the load."""
        filled = {"id", "inserted_at", "dedupe_status", "modality", *(n for n, k, _ in self.schema if k == "J")}
        return [n for n, _, nullable in self.schema if not nullable and n not in filled]

    def kind(self, name: str) -> str:
        return {n: k for n, k, _ in self.schema}[name]

    def field(self, kind: str, name: str) -> str:
        """name if the dataset has such a field of this kind ('category', 'metric', 'extra'), else a ValueError."""
        if name not in getattr(self, f"{kind}_fields"):
            raise ValueError(f"{self.name} has no {kind} field {name!r}")
        return name


def _modality(name: str, metrics, series, more=(), drop=(), tasks=()) -> DatasetSpec:
    return DatasetSpec(
        name=name, id_col="source_api_id", time_col="source_created_at", tie_col="id", exact_key="dedupe_exact_key", series_key="dedupe_series_key",
        filters={"manufacturers": "manufacturer", "versions": "pipeline_version", "tasks": "task_id"},
        category_fields=("manufacturer", "manufacturers_model_name", "pipeline_version", *tasks),
        metric_fields=tuple(n for n, _, _ in metrics),
        important_fields=tuple(x for x in ["session_id", "run_id", "acq_id", *tasks, "manufacturer", "manufacturers_model_name", "magnetic_field_strength", "echo_time", "inversion_time", "repetition_time"] if x not in drop),
        extra_fields=("payload_extra", "bids_meta_extra", "provenance_settings_extra", "provenance_extra", *(["rating_extra"] if more else [])),
        sample_fields=tuple(SAMPLES), series_fields=tuple(series),
        schema=tuple([*SOURCE, *IDENTITY, *ACQUISITION, ("bids_meta_extra", "J", False), *metrics, ("modality", "S", False), *more]),
    )


MODALITIES = {
    "T1w": _modality("T1w", STRUCTURAL, STRUCTURAL_SERIES),
    "T2w": _modality("T2w", STRUCTURAL, STRUCTURAL_SERIES, drop=("inversion_time",)),
    "bold": _modality("bold", BOLD, BOLD_SERIES, more=RATING, drop=("inversion_time",), tasks=("task_id", "task_name")),
}


def modality(name: str) -> DatasetSpec:
    """The spec of a modality; names are case-sensitive."""
    if name not in MODALITIES:
        raise ValueError(f"unknown modality {name!r}; known: {', '.join(MODALITIES)}")
    return MODALITIES[name]
