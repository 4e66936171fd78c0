"""Dumps: a JSON array of observations for each modality, in MongoDB's Extended JSON.

One file is read by many tasks, each a range of its bytes. Whether a range begins within a string is not known at
first, so a first pass looks at each range under each assumption (outside a string, inside, inside after a
backslash) and sums it up: how it ends, how much deeper, and how many commas stand at which depth. The summaries, one after
the other, give each range its true beginning and the number of items before it; a second pass emits the items that
begin in a range. The ranges with their item numbers are an index of the file: a load that goes on after item N
reads none of the ranges before it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.files import opened
from ..spec import MODALITIES
from .folders import exists, files, status

#: Bytes of a range, of a step of a scan, and of the items of one batch.
RANGE, STEP, BATCH = 64 << 20, 4 << 20, 8 << 20
#: How a structural sign changes the depth; -2: no such sign.
DEEPER = np.full(256, -2, np.int8)
DEEPER[[ord(c) for c in "[{"]], DEEPER[[ord(c) for c in "]}"]], DEEPER[ord(",")] = 1, -1, 0
BLANK = b" \t\r\n"


def resolve_dump_root(spark: SparkSession, root: str) -> dict[str, str]:
    """The dump files <anything>.<modality>.json of a folder by modality; the folder must exist and hold one at least."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    found = {m: f"{root.rstrip('/')}/{f}" for m in MODALITIES for f in files(spark, root) if f.endswith(f".{m}.json")}
    if not found:
        raise FileNotFoundError(f"no dump file in {root}")
    return found


def unwrapped(value: Column) -> Column:
    """JSON text without Extended JSON wrappers, at any depth: numbers and ids take the place of their objects, {"$date": ...} becomes its text or, given in milliseconds, {"$date": n}. Any other {"$...": } is an error."""
    v = F.regexp_replace(value, r'\{\s*"\$number(?:Int|Long|Double|Decimal)"\s*:\s*"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"\s*\}', "$1")
    v = F.regexp_replace(v, r'\{\s*"\$(?:number(?:Int|Long|Double|Decimal)|oid|date)"\s*:\s*("(?:[^"\\]|\\.)*")\s*\}', "$1")
    v = F.regexp_replace(v, r'\{\s*"\$number(?:Int|Long|Double|Decimal)"\s*:\s*(-?[0-9][^}\s]*)\s*\}', "$1")
    other = F.regexp_extract(F.regexp_replace(v, r'\{\s*"\$date"\s*:\s*-?[0-9]+\s*\}', "0"), r'\{\s*"(\$[A-Za-z]+)"\s*:', 1)
    return F.when(other == "", v).otherwise(F.raise_error(F.concat(F.lit("unknown wrapper "), other)).cast("string"))


class Scan:
    """A scan of JSON bytes, piece after piece: whether it is in a string, after a backslash, and how deep."""

    def __init__(self, quoted: bool = False, escaped: bool = False, depth: int = 0):
        self.quoted, self.escaped, self.depth = quoted, escaped, depth

    def step(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the structural signs (brackets and commas outside strings) of a piece, how each changes the depth, and the depth after it."""
        n = len(data)
        slash = data == ord("\\")
        place = np.arange(n)
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(slash, -1, place))])  # before each place (and the end) the last that is no backslash
        run = np.arange(n + 1) - 1 - last + np.where(last < 0, int(self.escaped), 0)
        odd = run % 2 == 1
        quotes = np.cumsum((data == ord('"')) & ~odd[:n])
        outside = (np.concatenate([[0], quotes[:-1]]) + self.quoted) % 2 == 0
        at = np.flatnonzero(outside & (DEEPER[data] != -2))
        change = DEEPER[data[at]].astype(np.int64)
        depth = self.depth + np.cumsum(change)
        self.quoted = bool((quotes[-1] + self.quoted) % 2)
        self.escaped = bool(odd[n]) and self.quoted
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return at, change, depth


@dataclass(frozen=True)
class Range:
    """Bytes start to end of a file, how the scan stands at the start, the items that begin before it and in it."""

    start: int
    end: int
    quoted: bool
    escaped: bool
    depth: int
    before: int
    items: int


@dataclass(frozen=True)
class Index:
    """The ranges of a file of that size and time of change."""

    size: int
    modified: int
    ranges: tuple[Range, ...]

    def as_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of_json(cls, text: str) -> Index:
        said = json.loads(text)
        return cls(said["size"], said["modified"], tuple(Range(**r) for r in said["ranges"]))

    def after(self, item: int) -> list[Range]:
        """The ranges in which items after that one begin."""
        return [r for r in self.ranges if r.items and r.before + r.items > item]


def read_bytes(f, most: int) -> np.ndarray:
    return np.frombuffer(f.read(most), np.uint8)


def summary(path: str, start: int, end: int, quoted: bool, escaped: bool) -> list:
    """A range under an assumption: how it ends (quoted, escaped, depth from 0), the commas by depth and the opening brackets by the depth before them."""
    scan, commas, opens = Scan(quoted, escaped), Counter(), Counter()
    system, name = opened(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        while start < end and len(data := read_bytes(f, min(STEP, end - start))):
            _, change, depth = scan.step(data)
            start += len(data)
            for found, where in ((commas, depth[change == 0]), (opens, depth[change == 1] - 1)):
                values, n = np.unique(where, return_counts=True)
                found.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
    return [scan.quoted, scan.escaped, scan.depth, dict(commas), dict(opens)]


def index(spark: SparkSession, path: str, range_bytes: int = RANGE) -> Index:
    """Look at a whole file; a row for each range, some hundred bytes, comes to the driver."""
    size, modified = status(spark, path)
    n = -(-size // range_bytes)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                bounds = k * range_bytes, min(size, (k + 1) * range_bytes)
                said = [summary(path, *bounds, *state) for state in ((False, False), (True, False), (True, True))]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([json.dumps(said)])], ["k", "said"])

    found = {r.k: json.loads(r.said) for r in spark.range(0, n, 1, min(n, 100_000)).mapInArrow(run, "k long, said string").collect()} if n else {}
    quoted = escaped = False
    depth, before, ranges = 0, 0, []
    for k in range(n):
        ends_quoted, ends_escaped, deeper, commas, opens = found[k][2 if escaped else int(quoted)]
        items = commas.get(str(1 - depth), 0) + (opens.get(str(-depth), 0) if not before and not any(r.items for r in ranges) else 0)
        ranges.append(Range(k * range_bytes, min(size, (k + 1) * range_bytes), quoted, escaped, depth, before, items))
        quoted, escaped, depth, before = ends_quoted, ends_escaped, depth + deeper, before + items
    if quoted or depth:
        raise ValueError(f"the array doesn't end: {path}")
    system, name = opened(path)
    with system.open_input_file(name) as f:
        first = b""
        while not first and (data := f.read(1 << 16)):
            first = data.lstrip(BLANK)
    if first[:1] != b"[":
        raise ValueError(f"a dump is a JSON array: {path}")
    return Index(size, modified, tuple(ranges))


def items_of(path: str, r: Range) -> Iterator[tuple[int, bytes]]:
    """The items that begin in a range, with their numbers; the last one's bytes may lie beyond it."""
    scan, at, number = Scan(r.quoted, r.escaped, r.depth), r.start, r.before
    held: list[bytes] | None = None  # of an item that has begun
    system, name = opened(path)
    with system.open_input_file(name) as f:
        f.seek(at)
        while at < r.end or held is not None:
            data = read_bytes(f, min(STEP, r.end - at) if at < r.end else STEP)
            if not len(data):
                raise ValueError(f"the array doesn't end: {path}")
            places, change, depth = scan.step(data)
            edge = ((change == 0) & (depth == 1)) | ((change == 1) & (depth == 1)) | ((change == -1) & (depth == 0))
            begun = 0
            for place, kind in zip(places[edge].tolist(), change[edge].tolist(), strict=True):
                if held is not None:
                    text = b"".join([*held, data[begun:place].tobytes()]).strip(BLANK)
                    if text or kind == 0:
                        yield number, text
                    held = None
                if at >= r.end:
                    return
                if kind >= 0:
                    held, number, begun = [], number + 1, place + 1
            if held is not None:
                held.append(data[begun:].tobytes())
            at += len(data)


def read_items(spark: SparkSession, path: str, start_after: int = 0, *, known: Index | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(value, raw_payload_path, source_page, item_index) of the items of one dump file after a number, item_index from 1; lineage is <path>#item=N.

    known: the file's index, if it has been made before. The file must lie in a store that Arrow's file systems reach
    from the executors. An item that isn't JSON is an error, and so is an array that doesn't end. What follows
    the array's end is not looked at.
    """
    known = known or index(spark, path, range_bytes)
    wanted = [tuple(asdict(r).values()) for r in known.after(start_after)]
    kinds = "start long, end long, quoted boolean, escaped boolean, depth int, before long, items long"
    ranges = spark.createDataFrame(wanted, kinds)
    if len(wanted) > 1:
        ranges = ranges.repartitionByRange(len(wanted), "start")

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t.decode() for _, t in rows], pa.string())], ["item_index", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for i, text in items_of(path, Range(**row)):
                    if i <= start_after:
                        continue
                    try:
                        json.loads(text)
                    except ValueError as e:
                        raise ValueError(f"{path}#item={i} isn't JSON: {e}") from e
                    held.append((i, text))
                    size += len(text)
                    if size >= BATCH:
                        yield made(held)
                        held, size = [], 0
                if held:
                    yield made(held)

    items = ranges.mapInArrow(run, "item_index long, value string")
    return items.select(unwrapped(F.col("value")).alias("value"), F.concat(F.lit(f"{path}#item="), F.col("item_index")).alias("raw_payload_path"), F.lit(None).cast("int").alias("source_page"), "item_index")
