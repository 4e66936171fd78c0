"""Operator 9: byte-level BPE encoding and decoding by ranks.

Each match of the pre-tokenisation pattern is merged on its own. A segment tree over the byte positions of
a match holds, in its root, the leftmost pair of least rank; a merge changes the leaves of the pair, of its
right part and of the pair before it, and climbs from each of these to the root. Many short matches are
merged side by side (a tree per column of an array); a long match has a tree to itself.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .frames import column, pieces, ragged
from .pretoken import Memo

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes up to which matches are merged side by side.
SHORT = 64
NONE = np.int32(2**31 - 1)


def coder(path: str) -> Coder:
    """The coder of a rank file, kept by the worker for its next task."""
    return frames.remembered("bpe", path, lambda: Coder(path))


class Coder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_ends = np.cumsum([len(x) for x in tokens], dtype=np.int64)
        get = self.ranks.get
        pairs = {(a, b): rank for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None}
        self.pairs = pairs
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*pairs.values()], np.int32)[order]
        self.memo = Memo(self.encode_matches)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if they don't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_matches(self, matches: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(matches)
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for i, m in enumerate(matches):
            b = m.encode()
            if (whole := self.ranks.get(b)) is not None:
                out[i] = np.array([whole], np.uint32)
            elif len(b) > SHORT:
                out[i] = np.array(self.merge_long(b), np.uint32)
            else:
                by_size.setdefault(1 << (len(b) - 1).bit_length(), []).append((i, b))
        for size, found in by_size.items():
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                for (i, _), ids in zip(part, self.merge_short([b for _, b in part], size), strict=True):
                    out[i] = ids
        return out

    def merge_short(self, matches: list[bytes], size: int) -> list[np.ndarray]:
        """Trees of `size` leaves, one for each match; a leaf holds rank * SHORT + position of the pair that starts there."""
        n = len(matches)
        lengths = np.fromiter(map(len, matches), np.int64, n)
        raw = np.frombuffer(b"".join(m.ljust(size, b"\0") for m in matches), np.uint8).reshape(n, size)
        ids = self.byte[raw]
        at = np.arange(size)
        after = np.tile(at + 1, (n, 1))
        before = np.tile(at - 1, (n, 1))
        live = at[None, :] < lengths[:, None]
        tree = np.full((n, 2 * size), NONE, np.int32)
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        pair = (rank != NONE) & live[:, 1:]
        tree[:, size : 2 * size - 1][pair] = (rank * SHORT + at[:-1].astype(np.int32))[pair] if size > 1 else 0
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + size
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            best = tree[rows, 1]
            i = (best % SHORT).astype(np.int64)
            merged = (best // SHORT).astype(np.int64)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = merged
            live[rows, j] = False
            after[rows, i] = k
            has = k < lengths[rows]
            before[rows[has], k[has]] = i[has]
            leaf = np.full(len(rows), NONE, np.int32)
            rank = self.pair_rank(merged[has], ids[rows[has], k[has]])
            leaf[has] = np.where(rank == NONE, NONE, rank * SHORT + i[has].astype(np.int32))
            put(rows, j, np.full(len(rows), NONE, np.int32))
            put(rows, i, leaf)
            p = before[rows, i]
            has = p >= 0
            if has.any():
                at_row, at_p = rows[has], p[has]
                rank = self.pair_rank(ids[at_row, at_p], merged[has])
                put(at_row, at_p, np.where(rank == NONE, NONE, rank * SHORT + at_p.astype(np.int32)))
            rows = rows[tree[rows, 1] != NONE]
        flat = ids[live].astype(np.uint32)
        return np.split(flat, np.cumsum(live.sum(axis=1))[:-1])

    def merge_long(self, match: bytes) -> list[int]:
        """The same with one tree, of (rank, position) pairs as one integer."""
        n, get = len(match), self.pairs.get
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        ids = [int(self.byte[b]) for b in match]
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (rank := get((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = rank * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + size
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                low = value if value < other else other
                node >>= 1
                if tree[node] == low:
                    break
                tree[node] = value = low

        while (best := tree[1]) != none:
            rank, i = divmod(best, size)
            j = after[i]
            k = after[j]
            ids[i] = rank
            live[j] = 0
            after[i] = k
            put(j, none)
            right = None
            if k < n:
                before[k] = i
                right = get((rank, ids[k]))
            put(i, none if right is None else right * size + i)
            if (p := before[i]) >= 0:
                left = get((ids[p], rank))
                put(p, none if left is None else left * size + p)
        return [x for x, on in zip(ids, live, strict=True) if on]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        return self.memo.encode_texts(texts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, and how many each has."""
        ends = self.token_ends[ids]
        starts = np.where(ids > 0, self.token_ends[np.maximum(ids.astype(np.int64), 1) - 1], 0)
        lengths = ends - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.token_bytes[ragged(starts, lengths)].tobytes(), np.diff(total[edges])


def encode(docs: DataFrame, *, ranks_path: str = RANKS, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column `ids` (array<int>) of the ids of each whole text.

    Null and empty texts get an empty array; other columns, repeated rows and the row order within a
    partition stay as they are. One pass without a shuffle; a task holds a piece of texts at a time.
    """
    rows, fields, names = frames.carried(docs, text, [ids])
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        use = coder(ranks_path)
        for part in pieces(batches, "body"):
            got, counts = use.encode(column(part, "body").fill_null("").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(got.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(column(part, f.name) for f in fields), lists], schema.names)

    return rows.mapInArrow(run, schema).toDF(*names, ids)


def decode(encoded: DataFrame, *, ranks_path: str = RANKS, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with a binary column of the bytes that its ids stand for; a null list gives null. Ids outside the vocabulary are an error."""
    own = [f for f in encoded.schema.fields if f.name != text]
    names = [f.name for f in own]
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)]
    at_ids = names.index(ids)
    schema = T.StructType([*fields, T.StructField("text", T.BinaryType())])

    def run(batches):
        use = coder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(at_ids)
                counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                data, lengths = use.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                ends = np.cumsum(lengths)
                out = [None if null else data[e - n : e] for null, e, n in zip(lists.is_null().to_pylist(), ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], schema.names)

    return encoded.select(*[frames.named(n).alias(f.name) for n, f in zip(names, fields, strict=True)]).mapInArrow(run, schema).toDF(*names, text)


def round_trip(docs: DataFrame, *, ranks_path: str = RANKS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids, the digest of the ids and the digest of the bytes decoded from them.

    `encode`, `decode` and two digests in one pass, without ids or bytes leaving the task. Null and empty
    texts have no ids and the digests of nothing; a null id stays null; repeated rows give repeated rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        use = coder(ranks_path)
        for part in pieces(batches, "body"):
            ids, counts = use.encode(column(part, "body").fill_null("").to_pylist())
            data, lengths = use.decode(ids, counts)
            raw = ids.astype("<u4").tobytes()
            a, b = np.cumsum(counts), np.cumsum(lengths)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    column(part, "id"),
                    pa.array(counts),
                    pa.array([sha(raw[4 * (e - n) : 4 * e]) for e, n in zip(a.tolist(), counts.tolist(), strict=True)]),
                    pa.array([sha(data[e - n : e]) for e, n in zip(b.tolist(), lengths.tolist(), strict=True)]),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    frames.bounded_batches(docs.sparkSession)
    rows = docs.select(frames.named(id_col).alias("id"), frames.named(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    return round_trip(frames.table(spark, sf_dir, "documents"))
