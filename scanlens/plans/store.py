"""Observation tables and their representatives as keyed tables under one commit log (see tables.py).

A load brings rows in and lets the representatives of both duplicate kinds (<modality>_exact, <modality>_series)
follow in the same state, so that a reader never sees one without the other; with refresh=False they lag behind the
rows until a refresh.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dump, pages
from ..sources.folders import exists, put, status, text_of
from ..spec import MODALITIES, modality
from . import merge
from .parse import parse, validated
from .tables import KINDS, State, Tables

KEY = "source_api_id"


@dataclass
class ModalitySummary:
    page_count: int = 0
    observation_count: int = 0
    inserted_count: int = 0
    updated_count: int = 0
    rejected_count: int = 0


@dataclass
class LoadSummary:
    modalities: dict[str, ModalitySummary] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"modalities": {k: asdict(v) for k, v in self.modalities.items()}}


class Store:
    """Reads go to the last state, or to the one that was pinned."""

    def __init__(self, spark: SparkSession, root: str, pinned: State | None = None):
        self.spark, self.root, self._pinned = spark, root.rstrip("/"), pinned
        self.tables = Tables(spark, self.root)

    def state(self) -> State:
        return self._pinned or self.tables.pin()

    def pinned(self) -> Store:
        """A store whose reads are all of one state, whatever is loaded meanwhile."""
        return Store(self.spark, self.root, self.state())

    def version(self, table: str) -> int:
        """The state that changed a table last, 0 if it isn't there."""
        found = self.state().tables.get(table)
        return found.changed if found else 0

    def versions(self) -> tuple[int, ...]:
        """The versions of all tables: changes with every load and refresh."""
        at = self.state().tables
        return tuple(at[t].changed if t in at else 0 for m in MODALITIES for t in (m, *(f"{m}_{k}" for k in KINDS)))

    def read(self, name: str) -> DataFrame:
        """A modality's rows; an empty table before the first load."""
        return self.state().read(name, modality(name).struct)

    def snapshot(self, name: str, kind: str) -> DataFrame | None:
        """The stored representatives, None before the first refresh."""
        state = self.state()
        return state.read(f"{name}_{kind}", modality(name).struct) if f"{name}_{kind}" in state.tables else None

    def create(self) -> None:
        """Give every table that isn't there an empty first state."""
        for name in MODALITIES:
            self.tables.create(name)
        self.refresh()

    def refresh(self, names: list[str] | None = None) -> None:
        """Make the representatives of the current rows anew."""
        for name in names or list(MODALITIES):
            self.tables.refresh(modality(name), modality(name).struct)

    def vacuum(self, keep: int = 2, seconds: float = 86400.0) -> list[str]:
        return self.tables.vacuum(keep, seconds)

    def staged(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written once: parsing is done once, and later plans start from plain columns. vacuum() deletes what's left."""
        path = f"{self.root}/_staged/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def merge_rows(self, name: str, rows: DataFrame, last_wins: bool, refresh: bool = True) -> tuple[int, int, int]:
        """Bring parsed rows in; the numbers of rows, of new keys and of known ones."""
        order = ["raw_payload_path", "item_index"] if last_wins else ["item_index"]
        one = merge.one_per_key(rows, KEY, [c for c in (["source_page", *order]) if c in rows.columns], last_wins)
        one = merge.numbered(one, order, 0, "number__").withColumn("inserted_at", F.current_timestamp())
        one = self.staged(name, one)  # numbers are given once, whatever reads them again
        new, known = self.tables.merge_rows(modality(name), modality(name).struct, one, last_wins=last_wins, keep=("id", "inserted_at") if last_wins else (), number="number__", views=refresh)
        return rows.count(), new, known

    def dump_index(self, path: str) -> dump.Index:
        """A dump file's index, which is made once for each state of the file and kept beside the tables."""
        kept = f"{self.root}/_index/{hashlib.sha256(path.encode()).hexdigest()}.json"
        if exists(self.spark, kept):
            try:
                found = dump.Index.of_json(text_of(self.spark, kept))
                if (found.size, found.modified) == status(self.spark, path):
                    return found
            except (ValueError, KeyError, TypeError):
                pass  # a load that broke off has left part of it
        found = dump.index(self.spark, path)
        put(self.spark, kept, found.as_json())
        return found

    def load_run(self, run_root: str, names: list[str] | None = None, *, quarantine: bool = False, refresh: bool = True) -> LoadSummary:
        """Load a run's page files; a known observation is replaced by the new one."""
        out = LoadSummary()
        for name in names or list(MODALITIES):
            items = pages.read_items(self.spark, run_root, name)
            if items is None:
                continue
            rows, bad = validated(self.staged(name, parse(items, name)), modality(name), quarantine=quarantine)
            n, new, known = self.merge_rows(name, rows, last_wins=True, refresh=refresh)
            out.modalities[name] = ModalitySummary(items.select("raw_payload_path").distinct().count(), n, new, n - new, bad.count() if bad is not None else 0)
        return out

    def load_dump(self, dump_root: str, names: list[str] | None = None, *, quarantine: bool = False, refresh: bool = True) -> LoadSummary:
        """Load dump files; known observations are skipped, and so are the items that a load before this one has taken from the same file."""
        out = LoadSummary()
        for name, path in dump.resolve_dump_root(self.spark, dump_root).items():
            if names and name not in names:
                continue
            done = merge.resume_index(self.read(name), path).first()[0]
            items = dump.read_items(self.spark, path, done, known=self.dump_index(path))
            rows, bad = validated(self.staged(name, parse(items, name)), modality(name), quarantine=quarantine)
            n, new, known = self.merge_rows(name, rows, last_wins=False, refresh=refresh)
            out.modalities[name] = ModalitySummary(1, n + done, new, n - new + done, bad.count() if bad is not None else 0)
        return out
