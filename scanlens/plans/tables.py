"""Keyed tables in hash buckets and views of them, bound together by one commit log.

<root>/data/<table>/<id>/bucket__=B holds a bucket's rows; nothing there is ever changed. <root>/_log/N.json, the
N-th state, names for every table the folder of each bucket. A load writes new folders for the buckets that its keys
fall in, and then puts the next entry of the log, if nobody has put it meanwhile. A load that breaks off has put
no entry: what it wrote is never read and bars nobody. If another load was first, this one goes on from the new
state: as it is if the tables that it has read are the same, else it merges again. A reader pins one state, and reads all
tables as they are in it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.views import group_key, representatives
from ..sources.folders import age, drop, exists, files, put_if_absent, subfolders, text_of
from ..spec import DatasetSpec
from . import merge

#: Buckets of a new table, how often a load is merged again when others come first, and the name of the bucket's column.
BUCKETS, TRIES, BUCKET = 16, 20, "bucket__"
KINDS = ("exact", "series")


@dataclass(frozen=True)
class Table:
    """A table in a state of the log: the folder of each bucket that has rows, the next free number, and the state that changed it last."""

    buckets: int = BUCKETS
    next_id: int = 1
    changed: int = 0
    folders: dict[str, str] = field(default_factory=dict)


class State:
    """All tables as they are in one entry of the log."""

    def __init__(self, spark: SparkSession, root: str, version: int, tables: dict[str, Table]):
        self.spark, self.root, self.version, self.tables = spark, root, version, tables

    def read(self, name: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets; a table that isn't there is empty."""
        folders = self.tables[name].folders if name in self.tables else {}
        paths = [f"{self.root}/{p}" for b, p in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def buckets_in(rows: DataFrame, key: Column, buckets: int) -> list[int]:
    """The buckets that rows fall in: at most as many values as there are buckets."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


class Tables:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def latest(self) -> int:
        """The number of the log's last entry, 0 for none."""
        return max((int(f[:-5]) for f in files(self.spark, f"{self.root}/_log") if f.endswith(".json") and f[0] != "."), default=0)

    def pin(self, version: int | None = None) -> State:
        """The last state, or an earlier one that vacuum() has left."""
        version = self.latest() if version is None else version
        said = json.loads(text_of(self.spark, f"{self.root}/_log/{version:012d}.json")) if version else {}
        return State(self.spark, self.root, version, {n: Table(**t) for n, t in said.items()})

    def commit(self, make: Callable[[State], tuple[dict[str, Table], set[str], object]]) -> object:
        """Put a new state. make: from a state, the tables that it has written anew, the tables that these depend on, and its answer."""
        for _ in range(TRIES):
            seen = self.pin()
            made, uses, answer = make(seen)
            while all((now := self.pin()).tables.get(n) == seen.tables.get(n) for n in uses | made.keys()):
                to = now.version + 1
                tables = now.tables | {n: replace(t, changed=to) for n, t in made.items()}
                if put_if_absent(self.spark, f"{self.root}/_log/{to:012d}.json", json.dumps({n: asdict(t) for n, t in tables.items()})):
                    return answer
        raise RuntimeError(f"{TRIES} loads in a row were overtaken by others")

    def written(self, name: str, table: Table, rows: DataFrame, key: Column, touched: list[int] | None, sort: str) -> Table:
        """The table with the touched buckets (None: all) made of rows. Spark splits large buckets and puts small ones together."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, bucket_of(key, table.buckets)).hint("rebalance", F.col(BUCKET))
        dealt.sortWithinPartitions(BUCKET, sort).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        new = {f.partition("=")[2]: f"{folder}/{f}" for f in subfolders(self.spark, f"{self.root}/{folder}") if f.startswith(f"{BUCKET}=")}
        kept = {b: p for b, p in table.folders.items() if touched is not None and int(b) not in touched}
        return replace(table, folders=kept | new)

    def merge_rows(self, spec: DatasetSpec, schema: T.StructType, rows: DataFrame, *, last_wins: bool, keep: tuple[str, ...] = (), number: str | None = None, views: bool = True) -> tuple[int, int]:
        """Bring rows (a written table, one for each key) in; how many keys are new and how many known.

        last_wins: a row takes the place of that of its key, but for the columns in keep; otherwise known keys
        are skipped. number: a column of rows, numbers from 0, that becomes the table's number (spec.tie_col) of new
        rows, beyond all others. views: the representatives follow, of those groups only that the rows come into or leave.
        """
        name, key = spec.name, spec.id_col
        touched: dict[int, list[int]] = {}

        def make(seen: State):
            table = seen.tables.get(name) or Table(self.buckets)
            if table.buckets not in touched:
                touched[table.buckets] = buckets_in(rows, F.col(key), table.buckets)
            own = touched[table.buckets]
            old = seen.read(name, schema, own)
            new = rows.withColumn(spec.tie_col, F.col(number) + table.next_id).drop(number) if number else rows
            new = new.select(*schema.names)
            after = merge.upsert(old, new, key, list(keep)) if last_wins else merge.insert_or_skip(old, new, key)
            made = {name: self.written(name, table, merge.conform(after, schema), F.col(key), own, spec.time_col)}
            if number:
                made[name] = replace(made[name], next_id=table.next_id + 1 + (rows.agg(F.max(number)).first()[0] or 0))
            known = merge.existing(rows.select(key), old, key).count()
            if views:
                then = State(self.spark, self.root, seen.version, seen.tables | made)
                for kind in KINDS:
                    made[f"{name}_{kind}"] = self.follow(then, spec, schema, kind, rows, merge.existing(old, rows, key))
            return made, {name, *(f"{name}_{k}" for k in KINDS if views)}, (rows.count() - known, known)

        return self.commit(make)

    def follow(self, state: State, spec: DatasetSpec, schema: T.StructType, kind: str, rows: DataFrame, before: DataFrame) -> Table:
        """The view's next table: groups of the rows and of what these were before are ranked again, others stay as they are."""
        name, group = f"{spec.name}_{kind}", group_key(spec, kind)
        if name not in state.tables:  # the first time: all groups
            return self.written(name, Table(self.buckets), representatives(state.read(spec.name, schema), spec, kind), group, None, spec.time_col)
        table = state.tables[name]
        groups = rows.select(group.alias("group__")).unionByName(before.select(group.alias("group__"))).distinct()
        touched = buckets_in(groups, F.col("group__"), table.buckets)
        return self.written(name, table, followed(state.read(spec.name, schema), state.read(name, schema, touched), groups, spec, kind), group, touched, spec.time_col)

    def refresh(self, spec: DatasetSpec, schema: T.StructType) -> None:
        """Make the views of a table anew from all its rows."""

        def make(seen: State):
            rows = seen.read(spec.name, schema)
            made = {f"{spec.name}_{k}": self.written(f"{spec.name}_{k}", Table(self.buckets), representatives(rows, spec, k), group_key(spec, k), None, spec.time_col) for k in KINDS}
            return made, {spec.name}, None

        self.commit(make)

    def create(self, name: str) -> None:
        """Give a table that isn't there an empty first state."""
        self.commit(lambda seen: ({} if name in seen.tables else {name: Table(self.buckets)}, {name}, None))

    def vacuum(self, keep: int = 2, seconds: float = 86400.0) -> list[str]:
        """Delete all but the last `keep` states, and the data that none of these names and that is older than `seconds` (younger data may be a load's that goes on); the folders that went."""
        last = self.latest()
        for v in [int(f[:-5]) for f in files(self.spark, f"{self.root}/_log") if f.endswith(".json") and f[0] != "."]:
            if v <= last - keep:
                drop(self.spark, f"{self.root}/_log/{v:012d}.json")
        left = [self.pin(v) for v in range(max(1, last - keep + 1), last + 1) if exists(self.spark, f"{self.root}/_log/{v:012d}.json")]
        named = {p.rpartition("/")[0] for s in left for t in s.tables.values() for p in t.folders.values()}
        there = [f"data/{n}/{f}" for n in subfolders(self.spark, f"{self.root}/data") for f in subfolders(self.spark, f"{self.root}/data/{n}")]
        there += [f"_staged/{f}" for f in subfolders(self.spark, f"{self.root}/_staged")]
        gone = [f for f in there if f not in named and age(self.spark, f"{self.root}/{f}") >= seconds]
        for f in gone:
            drop(self.spark, f"{self.root}/{f}")
        return gone


def followed(rows: DataFrame, view: DataFrame, groups: DataFrame, spec: DatasetSpec, kind: str) -> DataFrame:
    """A view after a load: representatives of the groups (group__), and the view's rows of other groups."""
    group = group_key(spec, kind)
    again = representatives(rows.join(groups, group == F.col("group__"), "left_semi"), spec, kind)
    return view.join(groups, group == F.col("group__"), "left_anti").unionByName(again)
