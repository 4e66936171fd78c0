"""Answers as plain dicts, as an API hands them out, with a cache of answers."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from .functions import labels
from .operators import duplicates, profile, views
from .operators.filters import ObservationFilters, apply_filters
from .plans.files import Folder, stamp
from .plans.store import Store
from .spec import MODALITIES, modality

NO_FILTERS = ObservationFilters()


def plain(value):
    return value.isoformat() if isinstance(value, datetime) else value


def rows(df: DataFrame) -> list[dict]:
    """A small result as dicts."""
    return [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]


@dataclass
class Kept:
    answer: object
    until: float
    used: int


class Answers:
    """Answers that stay good for a while. There is room for so many; beyond it those go first that are out of date, then the one that was wanted longest ago. A missing answer isn't kept."""

    def __init__(self, good_for: float = 300, room: int = 256, now: Callable[[], float] = time.monotonic):
        self.good_for, self.room, self.now = good_for, room, now
        self.guard, self.kept, self.turn = threading.Lock(), {}, 0

    def recall(self, question) -> Kept | None:
        with self.guard:
            self.turn += 1
            one = self.kept.get(question)
            if one is None or one.until <= self.now():
                return None
            one.used = self.turn
            return one

    def keep(self, question, answer) -> None:
        with self.guard:
            self.turn += 1
            self.kept[question] = Kept(answer, self.now() + self.good_for, self.turn)
            if len(self.kept) > self.room:
                now = self.now()
                self.kept = {q: k for q, k in self.kept.items() if k.until > now}
            while len(self.kept) > self.room:
                del self.kept[min(self.kept, key=lambda q: self.kept[q].used)]

    def forget(self) -> None:
        with self.guard:
            self.kept = {}


class Profiler:
    """Questions about the observations of a store."""

    def __init__(self, store: Store, *, snapshots: bool = True, filter_first: bool = False):
        self.store, self.snapshots, self.filter_first = store, snapshots, filter_first

    def view(self, name: str, view: str = "raw", filters: ObservationFilters = NO_FILTERS) -> DataFrame:
        stored = self.store.snapshot(name, view) if self.snapshots and view in ("exact", "series") else None
        return views.view(self.store.read(name), modality(name), view, filters, filter_first=self.filter_first, snapshot=stored)

    def pinned(self) -> Profiler:
        """The same questions about one state of the store."""
        return Profiler(self.store.pinned(), snapshots=self.snapshots, filter_first=self.filter_first)

    def overview(self, filters: ObservationFilters = NO_FILTERS) -> dict:
        now = self.pinned()
        return {"generated_at": datetime.now(UTC).isoformat(), "filters": filters.echo(), "modalities": [now.modality_overview(m, filters) for m in MODALITIES]}

    def modality_overview(self, name: str, filters: ObservationFilters = NO_FILTERS) -> dict:
        spec, now = modality(name), self.pinned()
        kept = {k: now.view(name, k, filters) for k in ("exact", "series")}
        counts = {r["view"]: r["row_count"] for r in rows(profile.overview(apply_filters(now.store.read(name), spec, filters), spec, kept))}
        span = rows(profile.view_summary(now.view(name, "raw", filters), spec))[0]
        return {"modality": name, "row_counts": counts, "source_created_at_range": {"min": span["first_created_at"], "max": span["last_created_at"]}}

    def missingness(self, name: str, view: str = "raw", filters: ObservationFilters = NO_FILTERS) -> list[dict]:
        found = rows(profile.missingness(self.view(name, view, filters), list(modality(name).important_fields)).orderBy("position"))
        return [{k: r[k] for k in ("field", "missing_count", "missing_fraction")} for r in found]

    def metric_summaries(self, name: str, view: str = "raw", filters: ObservationFilters = NO_FILTERS) -> list[dict]:
        found = rows(profile.metric_summaries(self.view(name, view, filters), list(modality(name).metric_fields)).orderBy("position"))
        return [{k: v for k, v in r.items() if k != "position"} for r in found]

    def metric_distribution(self, name: str, metric: str, view: str = "raw", filters: ObservationFilters = NO_FILTERS, bins: int = 20) -> dict:
        df = self.view(name, view, filters).select(modality(name).field("metric", metric))
        stats = rows(profile.metric_stats(df, metric))[0]
        quantiles = {q: stats.pop(q) for q in profile.QUANTILES}
        bars = rows(profile.histogram(df, metric, bins).orderBy("bin"))
        return {"field": metric, **stats, "quantiles": quantiles, "histogram": [{k: b[k] for k in ("start", "end", "count")} for b in bars]}

    def distribution(self, name: str, category: str, view: str = "raw", filters: ObservationFilters = NO_FILTERS, limit: int = 20) -> list[dict]:
        return rows(profile.top_values(self.view(name, view, filters), modality(name).field("category", category), limit))

    def extra_key_counts(self, name: str, column: str, view: str = "raw", filters: ObservationFilters = NO_FILTERS, limit: int = 25) -> dict:
        df = self.view(name, view, filters).select(modality(name).field("extra", column))
        return {"column": column, **rows(profile.extra_key_totals(df, column))[0], "keys": rows(profile.extra_key_counts(df, column, limit))}

    def duplicate_summary(self, name: str, kind: str, filters: ObservationFilters = NO_FILTERS, group_limit: int = 10, member_limit: int = 5) -> dict:
        return self.duplicate_summaries(name, (kind,), filters, group_limit, member_limit)[kind]

    def duplicate_summaries(self, name: str, kinds: tuple[str, ...] = ("exact", "series"), filters: ObservationFilters = NO_FILTERS, group_limit: int = 10, member_limit: int = 5) -> dict[str, dict]:
        """Two scans for all kinds: one for the groups, one for members of the largest."""
        spec, now = modality(name), self.pinned()
        df = apply_filters(now.store.read(name), spec, filters)
        found = rows(duplicates.bundle(df, spec, kinds, group_limit))
        largest = sorted((r for r in found if r["part"] == "group"), key=lambda r: r["rank"])
        members: dict[tuple, list] = {}
        if largest:
            top = now.store.spark.createDataFrame([(r["kind"], r["group_key"]) for r in largest], "kind string, group_key string")
            for r in sorted(rows(duplicates.samples_of(df, spec, top, kinds, member_limit)), key=lambda r: r["member"]):
                members.setdefault((r["kind"], r["group_key"]), []).append({k: v for k, v in r.items() if k not in ("kind", "group_key", "member")})
        out = {}
        for kind in kinds:
            bars = sorted(((r["group_size"], r["group_count"]) for r in found if r["kind"] == kind and r["part"] == "size" and r["group_size"] > 1), reverse=True)
            groups = [{**{k: r[k] for k in ("group_key", "group_size", "first_created_at", "last_created_at")}, "samples": members.get((kind, r["group_key"]), [])} for r in largest if r["kind"] == kind]
            out[kind] = {
                "kind": kind, "duplicate_group_count": sum(n for _, n in bars), "duplicate_row_count": sum(size * n for size, n in bars),
                "histogram": [{"group_size": size, "group_count": n} for size, n in bars], "sample_groups": groups,
            }
        return out

    def modality_profile(self, name: str, view: str = "raw", filters: ObservationFilters = NO_FILTERS, *, top_n: int = 10, group_limit: int = 10, member_limit: int = 5, key_limit: int = 25) -> dict:
        """Everything about a modality, in one state of the store. overview and duplicates are about all rows, whatever the view. The view is scanned once."""
        spec, now = modality(name), self.pinned()
        found = rows(profile.whole(now.view(name, view, filters), spec, top_n=top_n, key_limit=key_limit))
        heads = {(r["part"], r["field"]): r for r in found if r["rank"] is None}
        nothing = {"row_count": 0, "known_count": 0, "distinct_count": 0, "min": None, "max": None, "mean": None, "first_at": None, "last_at": None}
        head = lambda part, field: heads.get((part, field), nothing)
        ranked: dict[tuple, list] = {}
        for r in sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"]):
            ranked.setdefault((r["part"], r["field"]), []).append(r)

        def gone(h: dict) -> dict:
            n = h["row_count"] - h["known_count"]
            return {"missing_count": n, "missing_fraction": n / h["row_count"] if h["row_count"] else 0.0}

        def metric(field: str) -> dict:
            h = head("metric", field)
            return {"field": field, "value_count": h["known_count"], **gone(h), **{k: h[k] for k in ("min", "max", "mean")}}

        def extra(field: str) -> dict:
            h = head("extra", field)
            return {"column": field, "nonempty_row_count": h["known_count"], "distinct_key_count": h["distinct_count"], "keys": [{"key": r["value"], "row_count": r["row_count"]} for r in ranked.get(("extra", field), [])]}

        all_rows = head("view", name)
        return {
            "modality": name, "view": view, "filters": filters.echo(), "overview": now.modality_overview(name, filters),
            "view_summary": {"row_count": all_rows["row_count"], "first_created_at": all_rows["first_at"], "last_created_at": all_rows["last_at"]},
            "missingness": [{"field": f, **gone(head("missing", f))} for f in spec.important_fields], "metrics": [metric(f) for f in spec.metric_fields],
            "top_values": {c: [{"value": r["value"], "count": r["row_count"]} for r in ranked.get(("category", c), [])] for c in spec.category_fields},
            "extras": {c: extra(c) for c in spec.extra_fields},
            "duplicates": now.duplicate_summaries(name, filters=filters, group_limit=group_limit, member_limit=member_limit),
        }

    def modalities(self) -> list[dict]:
        """What can be asked for."""
        return [
            {"modality": m, "distribution_fields": list(s.category_fields), "extra_fields": list(s.extra_fields), "metrics": [{"field": f, "label": labels.label(f), "family": labels.family(f, m), "subfamily": labels.subfamily(f), "unit_hint": labels.unit(f)} for f in s.metric_fields]}
            for m, s in MODALITIES.items()
        ]

    def write_profile(self, folder: str, names: list[str] | None = None, view: str = "raw", filters: ObservationFilters = NO_FILTERS) -> str:
        """The overview and a profile of each modality as JSON files in <folder>/db-profiles/<run>; that folder's name."""
        names, out = names or list(MODALITIES), Folder(str(folder)) / "db-profiles" / stamp()
        answers = {"config": {"view": view, "filters": filters.echo(), "modalities": names}, "overview": self.overview(filters)}
        for name, answer in (answers | {m: self.modality_profile(m, view, filters) for m in names}).items():
            out.put_json(f"{name}.json", answer)
        return out.name


#: Bounds of the parameters of a question (fixed values).
BOUNDS = {"top_n": (1, 100), "group_limit": (1, 100), "member_limit": (1, 25), "key_limit": (1, 100), "limit": (1, 250), "bins": (1, 200)}


class Api:
    """Questions by path, as a web server would route them: answer(path, parameters) gives (status, body, whether the answer was kept)."""

    def __init__(self, profiler: Profiler, answers: Answers | None = None):
        self.profiler, self.answers = profiler, answers or Answers()

    def answer(self, path: str, filters: ObservationFilters = NO_FILTERS, **parameters) -> tuple[int, object, bool]:
        for name, value in parameters.items():
            if name in BOUNDS and not BOUNDS[name][0] <= value <= BOUNDS[name][1]:
                return 422, {"detail": f"{name} must lie within {BOUNDS[name]}"}, False
        p, parts = self.profiler, path.strip("/").split("/")
        match parts:
            case ["health"]:
                return 200, {"status": "ok", "tables": sum(v > 0 for v in p.store.versions())}, False  # asks the storage
            case ["modalities"]:
                make = p.modalities
            case ["overview"]:
                make = lambda: p.overview(filters)
            case ["modalities", m, "profile"]:
                make = lambda: p.modality_profile(m, filters=filters, **parameters)
            case ["modalities", m, "missingness"]:
                make = lambda: p.missingness(m, filters=filters, **parameters)
            case ["modalities", m, "distributions", f]:
                make = lambda: p.distribution(m, f, filters=filters, **parameters)
            case ["modalities", m, "extras", c]:
                make = lambda: p.extra_key_counts(m, c, filters=filters, **parameters)
            case ["modalities", m, "metrics"]:
                make = lambda: p.metric_summaries(m, filters=filters, **parameters)
            case ["modalities", m, "metrics", f]:
                make = lambda: p.metric_distribution(m, f, filters=filters, **parameters)
            case ["modalities", m, "duplicates", kind]:
                make = lambda: p.duplicate_summary(m, kind, filters, **parameters)
            case _:
                return 404, {"detail": "no such path"}, False
        try:
            key = (path, tuple(sorted(parameters.items())), filters, p.store.versions())
            if old := self.answers.recall(key):
                return 200, old.answer, True
            body = make()
            if body is not None:
                self.answers.keep(key, body)
            return 200, body, False
        except ValueError as e:
            return 404, {"detail": str(e)}, False
