"""Operator 5: n-gram Jaccard join with parity sketches.

A document is the set of its distinct word shingles. Every shingle flips one bit of a sketch, so the bits in
which two sketches differ are at most the shingles in which the sets differ, and J >= t allows at most
d = (1-t)/(1+t) * (|A|+|B|) of these. For a band of set sizes the (very wide) sketch is cut into m > d segments:
two sets that link agree in a segment in which they aren't empty, because differing shingles spoil d segments at
most. Segments (as XORs of shingle hashes, which say which bits are set) are the keys of a join; documents meet
in the keys they share, and pairs are verified on the sets themselves.

m is larger than d + 1, so linked sets share several keys, and each set may leave out as many of its keys as it
has to spare. All sets leave out their most frequent ones, in one order for all: the least frequent key that two
linked sets share is then left in both. What is left out are the keys of passages that many documents share.

No group's pairs are all written: a key of many documents gives a star, from which most of a group of near
copies becomes one component. Documents of different components that share a key are compared by sketches, in
blocks: at first every one names its nearest partner, then, if there were more, all partners of other components.
A key that's frequent among the documents of one pack goes to the join as one entry, its documents apart from it.
Equal sets are one node from the start.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames
from .components import components
from .frames import Scratch, column, pieces, ragged, small, text_bytes
from .pretoken import mix
from .words import NOT_BLANK, shingles, spans

SIZE, PERCENT = 5, 80
#: Keys that a bucket of the join holds (about), bytes of text whose keys are packed together, documents of a key whose pairs are all taken, documents of a pack from which on a key is sent as one entry.
BUCKET_KEYS, PACK_BYTES, FEW, FREQUENT = 1_000_000, 16 << 20, 6, 256
#: A key's documents that are compared by sketches at a time: blocks of so many, larger ones if there would be more blocks than MOST_BLOCKS (each document is sent once for each block), of so many bytes of sketches at most.
BLOCK, MOST_BLOCKS, BLOCK_BYTES = 2048, 8, 64 << 20
#: Bits of a sketch: at least four for each shingle, within these bounds. Bits of the filter that says which sets are looked at again, at most.
LEAST_BITS, MOST_BITS, FILTER_BITS = 256, 1 << 16, 1 << 26
BAND = 1.4  # at least; wider for thresholds under 72 percent
LOW = np.uint64(0xFFFFFFFFFFFF)  # what a bucket knows of a key: 48 bits
#: What meet() returns: pairs of documents (a, b, keys shared), members of a key of many documents (key: the members' group, a: document, b: members, n: keys of the group), members and groups of keys that are frequent in packs (key and a: document, or key, a: group, b: members). spare: keys that a document may leave out.
PAIR, MEMBER, APART, GROUP = range(4)
MET = "kind int, key long, a long, b long, n long, spare long"


@dataclass(frozen=True)
class Plan:
    """Size bands and their numbers of segments for a threshold in percent."""

    percent: int = PERCENT

    def __post_init__(self):
        if not 1 <= self.percent <= 100:
            raise ValueError("percent must be from 1 to 100")

    @property
    def least_size(self) -> int:
        """The fewest shingles of a set that can link with another set."""
        return -(-self.percent // max(1, 100 - self.percent))

    def most_apart(self, sizes: int) -> int:
        """The most shingles in which two linked sets of so many shingles together differ."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def least_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def uppers(self, largest: int) -> list[int]:
        """Upper bounds of the bands, one beyond the largest set's: linked sets are of the same band or of neighbours."""
        out = [4]
        while len(out) < 2 or out[-2] < largest:
            out.append(max(out[-1] + 1, int(out[-1] * BAND), 100 * out[-1] // self.percent))
        return out

    def segments(self, upper: int) -> int:
        """Segments for sets of at most `upper` shingles: enough that the filled ones outnumber those that may be spoiled."""
        d = self.most_apart(2 * upper)
        return d + 1 + max(4, d // 4)


def sets_of(part: pa.RecordBatch, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each begins (one more)."""
    data, offsets = text_bytes(column(part, text))
    _, _, hashes, firsts = spans(data, offsets, NOT_BLANK)
    found, before = shingles(hashes, firsts, size)
    own = [np.unique(found[a:b]) for a, b in pairwise(before.tolist())]
    return (np.concatenate(own) if own else found), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def fingerprints(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    n = np.diff(firsts)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(values ^ np.uint64(0x5BF03635D1A1F1C7)), firsts[some]) + n[some].astype(np.uint64))
    return out.astype(np.int64)


def sketch(values: np.ndarray) -> bytes:
    """The parity sketch: bit (h mod bits) flipped for every shingle hash h; bits, a power of two, follows the size."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(values) - 1).bit_length()))
    return np.packbits(np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes], bits: int = MOST_BITS) -> np.ndarray:
    """Sketches as words, larger ones folded to the smallest one's bits, or to fewer."""
    least = min(bits // 8, *map(len, sketches)) if len(sketches) > 1 else min(bits // 8, len(sketches[0]))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, least // 8), axis=0)
    return out


def segment_keys(values: np.ndarray, firsts: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All join keys of sets, the set of each, and how many keys each set can spare: one less than a linked set shares with it, in each of its bands. A set takes part in its own band, and in the next one if that has sets near enough in size."""
    n = np.diff(firsts)
    spare = np.full(len(n), np.iinfo(np.int32).max, np.int64)
    uppers = np.array(plan.uppers(int(n.max(initial=0))))
    keys, owners = [], []
    own = np.searchsorted(uppers, n)
    for step in (0, 1):
        band = own + step
        first_size = uppers[band - 1] + 1 if step else 0
        takes = (n >= plan.least_size) & ((n >= -(-plan.percent * first_size // 100)) if step else True)
        docs = np.flatnonzero(takes)
        if not len(docs):
            continue
        m = np.array([plan.segments(int(u)) for u in uppers])[band[docs]]
        places = ragged(firsts[docs], n[docs])
        h = values[places]
        doc = np.repeat(np.arange(len(docs)), n[docs])
        segment = ((h >> np.uint64(20)) % np.repeat(m, n[docs]).astype(np.uint64)).astype(np.int64)
        base = np.cumsum(m) - m
        at = base[doc] + segment
        order = np.argsort(at, kind="stable")
        at = at[order]
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        body = np.bitwise_xor.reduceat(mix(h[order]), head)
        filled = at[head]
        owner = np.searchsorted(base, filled, "right") - 1
        number = filled - base[owner]
        salt = band[docs][owner].astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)
        keys.append(mix(body ^ mix(salt + np.uint64(1))))
        owners.append(docs[owner])
        filled_n = np.bincount(owner, minlength=len(docs))
        partner = np.minimum(uppers[band[docs]], 100 * n[docs] // plan.percent)  # the largest set that can link
        few = np.flatnonzero(filled_n <= np.array([plan.most_apart(2 * int(u)) for u in uppers])[band[docs]])
        over = filled_n - (100 - plan.percent) * (n[docs] + partner) // (100 + plan.percent) - 1
        over[few] = 0
        spare[docs] = np.minimum(spare[docs], np.maximum(over, 0))
        if len(few):  # too few filled segments for the guarantee: the empty ones are keys too
            every = ragged(base[few], m[few])
            empty = every[~np.isin(every, filled)]
            owner = np.searchsorted(base, empty, "right") - 1
            salt = band[docs][owner].astype(np.uint64) << np.uint64(32) | (empty - base[owner]).astype(np.uint64)
            keys.append(mix(mix(salt + np.uint64(1)) ^ np.uint64(0xE)))
            owners.append(docs[owner])
    spare[spare == np.iinfo(np.int32).max] = 0
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), spare
    return np.concatenate(keys), np.concatenate(owners), spare


def low_bytes(keys: np.ndarray) -> bytes:
    return (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((keys >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def low_keys(data: bytes) -> np.ndarray:
    count = len(data) // 6
    return np.frombuffer(data, "<u2", count, 4 * count).astype(np.uint64) << np.uint64(32) | np.frombuffer(data, "<u4", count)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def whole_key(low: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """A name for a key from what its bucket knows of it."""
    return mix((low & LOW) + np.asarray(bucket).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def frequent(keys: np.ndarray, least: int) -> np.ndarray:
    """The keys that stand `least` times or more in a pack."""
    slot = (keys >> np.uint64(44)).astype(np.int64)
    often = np.bincount(slot, minlength=1 << 20) >= least
    found, times = np.unique(keys[often[slot]], return_counts=True)
    return found[times >= least]


PACKED = ["bucket", "keys", "places", "nodes", "spares", "counts", "sums"]


def packer(text: str, size: int, keys_of, buckets: int):
    """Keys of documents (keys_of: sets to keys, owners, keys to spare) as rows (bucket, keys, places, nodes, spares): the nodes of a row and, for each key, which of them it's of.

    A frequent key is one entry (its least node) with the number and the hash of its other nodes (counts, sums).
    Its nodes go to a bucket beyond the others, which the pack picks, so that they are spread however many there are.
    """

    def row(bucket, keys, places, nodes, spares, counts=b"", sums=b""):
        values = [pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (low_bytes(keys), places.astype("<u4" if len(nodes) > 1 << 16 else "<u2").tobytes(), nodes.astype("<i8").tobytes(), spares.astype("<u4").tobytes(), counts, sums))]
        return pa.RecordBatch.from_arrays(values, PACKED)

    def apart(keys, owners, nodes, spares):
        """The rows of frequent keys, and which of the other entries are left."""
        often = frequent(keys, FREQUENT)
        if not len(often):
            return [], np.ones(len(keys), bool)
        place = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        hot = often[place] == keys
        order = np.lexsort((nodes[owners[hot]], place[hot]))
        key, own = place[hot][order], owners[hot][order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bucket = bucket_of(often, buckets)
        counts = np.diff(np.append(heads, len(key))) - 1
        least = own[heads]
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(nodes[own].astype(np.uint64)), heads) - mix(nodes[least].astype(np.uint64))
        rows = []
        for b in np.unique(bucket).tolist():
            i = np.flatnonzero(bucket == b)
            rows.append(row(b, often[i], np.arange(len(i)), nodes[least[i]], spares[least[i]], counts[i].astype("<i8").tobytes(), sums[i].astype("<u8").tobytes()))
        used, at = np.unique(own, return_inverse=True)
        beyond = buckets + int(nodes[used].astype(np.uint64).sum() % np.uint64(buckets))
        rows.append(row(beyond, often[key], at, nodes[used], spares[used], whole_key(often, bucket)[key].astype("<i8").tobytes()))
        return rows, ~hot

    def pack(keys, owners, nodes, spares):
        keys, owners, nodes, spares = (np.concatenate(x) for x in (keys, owners, nodes, spares))
        rows, rest = apart(keys, owners, nodes, spares)
        yield from rows
        keys, owners = keys[rest], owners[rest]
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            used, place = np.unique(owners[own], return_inverse=True)
            yield row(b, keys[own], place, nodes[used], spares[used])

    def run(batches):
        held, met, base, found = 0, set(), 0, []
        for part in pieces(batches, text):
            values, firsts = sets_of(part, text, size)
            prints = fingerprints(values, firsts)
            new = []
            for i, x in enumerate(prints.tolist()):  # a set that this pack has is not taken again
                if x not in met:
                    met.add(x)
                    new.append(i)
            new = np.array(new, np.int64)
            n = np.diff(firsts)[new]
            k, o, spare = keys_of(values[ragged(firsts[new], n)], np.concatenate([[0], np.cumsum(n)]))
            found.append((k, o + base, prints[new], spare))
            base += len(new)
            held += part.nbytes
            if held >= PACK_BYTES:
                yield from pack(*zip(*found, strict=True))
                held, met, base, found = 0, set(), 0, []
        if found:
            yield from pack(*zip(*found, strict=True))

    return run


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, node and spare of every entry."""
    keys, nodes, spares = [], [], []
    for k, p, n, x in zip(rows["keys"], rows["places"], rows["nodes"], rows["spares"], strict=True):
        place = np.frombuffer(p, "<u4" if len(n) > 8 << 16 else "<u2")
        keys.append(low_keys(k))
        nodes.append(np.frombuffer(n, "<i8")[place])
        spares.append(np.frombuffer(x, "<u4")[place])
    return np.concatenate(keys), np.concatenate(nodes), np.concatenate(spares).astype(np.int64)


def meeter(buckets: int):
    """A bucket's rows to those of MET."""

    def frame(kind, key, a, b, n, spare):
        return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "key": key, "a": a, "b": b, "n": n, "spare": spare})

    def stars(key, node):
        """Sorted by (key, node): the first node of each key with each of its others."""
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        others = np.diff(np.append(heads, len(key))) - 1
        return np.repeat(node[heads], others), node[ragged(heads + 1, others)]

    def counted(a, b):
        """Pairs, each once, and how many keys they share."""
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(a)))
        return frame(PAIR, 0, a[first], b[first], times, 0)

    def spread(rows):
        """The documents of keys that are frequent in a pack."""
        _, node, spare = unpacked(rows)
        key = np.concatenate([np.frombuffer(x, "<i8") for x in rows["counts"]])
        order = np.lexsort((node, key))
        key, node, spare = key[order], node[order], spare[order]
        keep = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, spare = key[keep], node[keep], spare[keep]
        return pd.concat([counted(*stars(key, node)), frame(APART, key, node, 0, 0, spare)])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        if bucket >= buckets:
            return spread(rows)
        key, node, spare = unpacked(rows)
        more, sums = [], []
        for k, c, x in zip(rows["keys"], rows["counts"], rows["sums"], strict=True):
            more.append(np.frombuffer(c, "<i8") if c else np.zeros(len(k) // 6, np.int64))
            sums.append(np.frombuffer(x, "<u8") if x else np.zeros(len(k) // 6, np.uint64))
        more, sums = np.concatenate(more), np.concatenate(sums)
        order = np.lexsort((node, key))
        key, node, spare, more, sums = key[order], node[order], spare[order], more[order], sums[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        more, sums = np.add.reduceat(more, first), np.add.reduceat(sums, first)
        key, node, spare = key[first], node[first], spare[first]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        here = np.diff(np.append(heads, len(key)))
        beyond = np.add.reduceat(more, heads)
        a, b = [], []
        one, two = stars(key, node)
        a.append(one)
        b.append(two)
        for g in range(3, FEW + 1):
            own = heads[(here == g) & (beyond == 0)]
            for i in range(1, g):
                for j in range(i + 1, g):
                    a.append(node[own + i])
                    b.append(node[own + j])
        out = [counted(np.concatenate(a), np.concatenate(b))]
        many = np.flatnonzero(here + beyond > FEW)
        if len(many):  # keys of the same members are one group
            start, count, total = heads[many], here[many], (here + beyond)[many]
            members = ragged(start, count)
            with np.errstate(over="ignore"):
                group = mix(np.add.reduceat(mix(node[members].astype(np.uint64)), np.cumsum(count) - count) + np.add.reduceat(sums, heads)[many]).astype(np.int64)
            _, at, times = np.unique(group, return_index=True, return_counts=True)
            own, n = ragged(start[at], count[at]), count[at]
            out.append(frame(MEMBER, np.repeat(group[at], n), node[own], np.repeat(total[at], n), np.repeat(times, n), spare[own]))
            split = beyond[many] > 0
            if split.any():
                out.append(frame(GROUP, whole_key(key[start[split]], bucket), group[split], total[split], 0, 0))
        return pd.concat(out)

    return meet


def node_filter(texts: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array with a bit for the hash of each text; FILTER_BITS bounds what comes to the driver (a word for every 64 bits)."""
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * texts.count()).bit_length()))
    at = F.pmod("hash", F.lit(bits))
    words = texts.select((at / 64).cast("long").alias("w"), (at % 64).cast("int").alias("s")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("word"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.word
    return out, bits


def sets_again(docs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, values): the sets of the given nodes, computed from one text of each again; a bit filter keeps most other texts from being looked at."""
    texts = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("hash").alias("hash")).select("hash").distinct()
    sent = docs.sparkSession.sparkContext.broadcast(node_filter(texts))

    def run(batches):
        words, bits = sent.value
        for batch in batches:
            at = column(batch, "hash").to_numpy() % bits
            batch = batch.filter(pa.array((words[at // 64] >> (at % 64)) & 1 == 1))
            for part in pieces([batch], "text"):
                values, firsts = sets_of(part, "text", size)
                prints = fingerprints(values, firsts)
                _, one = np.unique(prints, return_index=True)
                use = one[np.diff(firsts)[one] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(prints[use]), pa.array([values[firsts[i] : firsts[i + 1]].tobytes() for i in use.tolist()], pa.binary())], ["node", "values"])

    found = docs.select("text", "hash").mapInArrow(run, "node long, values binary").join(small(nodes), "node", "left_semi")
    return found.groupBy("node").agg(F.first("values").alias("values"))


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs (a, b) that link: 100 * |A and B| >= percent * |A or B|, on the sets. pairs: a written table."""
    one = sets.select(F.col("node").alias("b"), F.col("values").alias("y")).join(small(pairs), "b")
    two = sets.select(F.col("node").alias("a"), F.col("values").alias("x")).join(small(pairs.select("a").distinct()), "a", "left_semi")
    both = one.join(two, "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            links = []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(one) > len(two):
                    one, two = two, one
                place = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common = int(np.count_nonzero(two[place] == one))
                links.append(100 * common >= plan.percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, described: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs (a, b, n) whose sizes and sketches don't rule a link out."""
    one = described.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    two = described.select(F.col("node").alias("b"), F.col("size").alias("k"), F.col("sketch").alias("y"))
    near = pairs.join(one, "a").join(two, "b").where(100 * F.least("m", "k") >= plan.percent * F.greatest("m", "k"))

    def run(batches):
        for batch in batches:
            keep = []
            for m, k, x, y in zip(*(column(batch, c).to_pylist() for c in ("m", "k", "x", "y")), strict=True):
                if len(x) == len(y):
                    apart = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
                else:
                    both = folded([x, y])
                    apart = int(np.bitwise_count(both[0] ^ both[1]).sum())
                keep.append(apart <= plan.most_apart(m + k))
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("a", "b", "n")], ["a", "b", "n"]).filter(pa.array(keep, pa.bool_()))

    return near.mapInArrow(run, "a long, b long, n long")


def members_of(met: DataFrame) -> DataFrame:
    """(key, node): the documents of every group of keys, without the keys that a document can spare: its most frequent ones."""
    groups = met.where(F.col("kind") == GROUP).select("key", F.col("a").alias("group"), F.col("b").alias("many"))
    apart = met.where(F.col("kind") == APART).select("key", F.col("a").alias("node"), "spare").join(small(groups), "key").select(F.col("group").alias("key"), "node", "many", F.lit(1).cast("long").alias("n"), "spare")
    rows = met.where(F.col("kind") == MEMBER).select("key", F.col("a").alias("node"), F.col("b").alias("many"), "n", "spare").unionByName(apart)
    rows = rows.groupBy("key", "node").agg(F.max("many").alias("many"), F.sum("n").alias("n"), F.min("spare").alias("spare"))
    so_far = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("many"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") > F.col("spare")).select("key", "node")


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a matrix of distances that have a partner, the nearest partner, and whether there are others."""
    have = d < 1 << 30
    n = have.sum(axis=1)
    rows = np.flatnonzero(n)
    return rows, d[rows].argmin(axis=1), n[rows] > 1


def across(members: DataFrame, described: DataFrame, roots: DataFrame, plan: Plan, open_: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of documents of different components that share a key and whose sketches don't rule a link out.

    members: key, node. A key's documents are compared in blocks, a row for each pair of blocks. Every document
    gives its nearest partner in each block (more: whether it has others there) or, with open_ (key, node), each
    of these gives all its partners.
    """
    everyone = open_ is not None
    if everyone:
        members = members.join(small(open_.select("key").distinct()), "key", "left_semi")
    members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = members.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    members = members.join(mixed, "key")
    flags = open_.withColumn("open", F.lit(True)) if everyone else None
    members = members.join(small(flags), ["key", "node"], "left").na.fill(False, ["open"]) if everyone else members.withColumn("open", F.lit(True))
    sizes = members.join(described.select("node", F.greatest(F.lit(LEAST_BITS // 8), F.least("size", F.lit(MOST_BITS // 8))).alias("bytes")), "node").groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.least(F.ceil(F.col("many") / BLOCK), F.lit(MOST_BLOCKS)), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = members.join(sizes.select("key", blocks.alias("blocks")), "key").join(described.select("node", "size", "sketch"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "size", "sketch", "open")

    def group(sketches, node, root, size, block, is_open, i, j):
        words = folded(sketches)
        if i == j:
            left = right = np.arange(len(node))
        else:
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for one, two in [(left, right)] + [(right, left)] * (i != j):
            one = one[is_open[one]]
            step = max(1, (1 << 22) // max(1, words[two].size))
            for at in range(0, len(one), step):
                x = one[at : at + step]
                a, b = np.nonzero((root[x][:, None] != root[two]) & (100 * np.minimum(size[x][:, None], size[two]) >= plan.percent * np.maximum(size[x][:, None], size[two])))
                d = np.full((len(x), len(two)), 1 << 30, np.int64)
                apart = np.bitwise_count(words[x[a]] ^ words[two[b]]).sum(axis=1, dtype=np.int64)
                ok = apart <= (100 - plan.percent) * (size[x[a]] + size[two[b]]) // (100 + plan.percent)
                d[a[ok], b[ok]] = apart[ok]
                if everyone:
                    a, b = np.nonzero(d < 1 << 30)
                    out.append((node[x[a]], node[two[b]], np.zeros(len(a), bool)))
                else:
                    a, b, more = nearest(d)
                    out.append((node[x[a]], node[two[b]], more))
        return [np.concatenate(v) for v in zip(*out, strict=True)] if out else []

    def groups(table: pa.Table):
        key, i, j, node, root, size, block = (table[c].to_numpy() for c in ("key", "i", "j", "node", "root", "size", "block"))
        is_open = table["open"].to_numpy().astype(bool)
        sketches = table["sketch"].to_pylist()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(key)]
        for a, b in pairwise(edges):
            if b - a > 1:
                found = group(sketches[a:b], node[a:b], root[a:b], size[a:b], block[a:b], is_open[a:b], int(i[a]), int(j[a]))
                if found and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), key[a])), *map(pa.array, found)], ["key", "x", "y", "more"])

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:  # rows come sorted; the last group of a batch may go on in the next one
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([*held, batch]).combine_chunks()
            k = [now[c].to_numpy() for c in ("key", "i", "j")]
            open_ = np.flatnonzero((k[0] == k[0][-1]) & (k[1] == k[1][-1]) & (k[2] == k[2][-1]))[0]
            if open_:
                yield from groups(now.slice(0, open_))
            held = now.slice(open_).to_batches()
        if held:
            yield from groups(pa.Table.from_batches(held))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(compare, "key long, x long, y long, more boolean")


def pairs_of(found: DataFrame) -> DataFrame:
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, keys=None, keys_each: int = 0) -> DataFrame:
    """Per row: the id, n_shingles and component_id (the smallest id that links reach, its own included).

    keys: makes other join keys than segments, as segment_keys does, about keys_each for each row.

    Rows without words are linked with nothing and their own component. Rows of one text always share a
    component. Null ids can be members but name a component only if it has no other id; repeated rows stay;
    other columns aren't kept; an empty table gives an empty one. Very long texts are sets like others, in
    memory one at a time. Ids need an order (numbers or strings).
    """
    spark, plan = docs.sparkSession, Plan(percent)
    scratch = Scratch(spark, "near-duplicates")
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))

    def describe(batches):
        for part in pieces(batches, "text"):
            values, firsts = sets_of(part, "text", size)
            sketches = [sketch(values[a:b]) for a, b in pairwise(firsts.tolist())]
            yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "hash"), pa.array(np.diff(firsts)), pa.array(fingerprints(values, firsts)), pa.array(sketches, pa.binary())], ["id", "hash", "size", "node", "sketch"])

    rows = scratch.written(docs.mapInArrow(describe, f"id {kind}, hash long, size long, node long, sketch binary"), "sets")
    total = rows.count() * keys_each if keys else 0.55 * (rows.agg(F.sum("size")).first()[0] or 0)
    buckets = max(1, int(total / BUCKET_KEYS))
    kinds = "bucket int, keys binary, places binary, nodes binary, spares binary, counts binary, sums binary"
    packed = docs.select("text").mapInArrow(packer("text", size, keys or partial(segment_keys, plan=plan), buckets), kinds)
    met = scratch.written(packed.groupBy("bucket").applyInPandas(meeter(buckets), MET), "met")
    described = scratch.written(rows.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")), "sketches")
    pairs = scratch.written(possible(met.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")), described, plan), "pairs")
    members = scratch.written(members_of(met), "members")
    scratch.drop(met)

    known: list[DataFrame] = []  # tables of sets

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among pairs, a written table; sets that aren't known yet are computed."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        for sets in known:
            ends = ends.join(sets, "node", "left_anti")
        ends = scratch.written(ends, "ends")
        if ends.count():
            known.append(scratch.written(sets_again(docs, rows, ends, size), "values"))
        scratch.drop(ends)
        sets = known[0] if known else rows.select("node", F.col("sketch").alias("values")).limit(0)
        for more in known[1:]:
            sets = sets.unionByName(more)
        return scratch.written(verified(pairs, sets, plan), "links")

    # the pair of each document that shares most keys with it first; these links make most components
    tried = scratch.written(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "tried")
    links = linked(tried)
    roots = components(links)
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("r")), roots.select(F.col("node").alias("b"), F.col("root").alias("s"))
    apart = F.coalesce("r", "a") != F.coalesce("s", "b")
    rest = pairs.join(left, "a", "left").join(right, "b", "left").where(apart).select("a", "b")
    found = scratch.written(across(members, described, roots, plan), "nearest")
    next_pairs = scratch.written(rest.unionByName(pairs_of(found)).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    tried, links = tried.unionByName(next_pairs), links.unionByName(linked(next_pairs))
    open_ = scratch.written(found.where("more").select("key", F.col("x").alias("node")).distinct(), "open")
    if open_.count():  # documents with more than one partner in a block: those of other components still
        roots = components(links)
        last = scratch.written(pairs_of(across(members, described, roots, plan, open_)).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(linked(last))
    roots = components(links)
    scratch.drop(members, described, pairs, found, open_, *known)
    own = rows.where("size > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = scratch.written(own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    names = scratch.written(named.select("node", "root").join(least, "root").select("node", "component"), "names")
    out = rows.select("id", "size", "node").join(names, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of J >= 0.8 on 5-word shingles."""
    return near_duplicates(frames.table(spark, sf_dir, "documents"))


#: Components in DuckDB for shingles of {size} words: all pairs that share a shingle, and a walk from each document along the links.
COMPONENTS_SQL = r"""WITH RECURSIVE d AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + {size} - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size} + 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) m USING (doc_id)"""
SQL = COMPONENTS_SQL.replace("{size}", str(SIZE))
