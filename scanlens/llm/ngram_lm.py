"""Operator 3: language-model scoring from a log-frequency Bloom filter.

Counts of n-grams of two words and more are quantised to levels, level = 1 + floor(log2 count); an n-gram of
level q is put into a Bloom filter as (n-gram, 1) ... (n-gram, q), and its level is read back by probing (n-gram,
1), (n-gram, 2), ... until one is missing. No probe is needed where the exact counts of the words, or the levels
of the shorter n-grams, say that there can't be one. The probability of a word is an interpolation, order by
order: the least count of the n-gram's level over the largest count of its context's level (for pairs: the exact
count), and below that the exact add-one unigram probability. So the probabilities after a context add up to 1
at most; what quantisation leaves of 1 is given to no word.

Filter and unigram counts are made in buckets (by hash) on the executors, and stay there: filters of any size
are too large for each worker in the end. Routes of buckets are sent to the tasks that need them, and the
distinct words and n-grams of each pack of texts come to them; counts and levels go back to the pack.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .frames import column, pieces, text_bytes, written
from .pretoken import mix
from .words import NOT_BLANK, spans

#: The token after the last word of a text; it's also what stands before the first.
END = np.uint64(0x2545F4914F6CDD1D)
#: Words of the longest n-grams, probes for their first level (a missing n-gram is found with probability 2**-PROBES; further levels take half as many), the share of each order in a probability.
ORDER, PROBES, WEIGHT = 2, 12, 0.4
#: Bytes of text for each bucket, bytes of text that are counted together, bytes of texts or model that are looked up in one place, bytes of text that ask together.
BUCKET_BYTES, PACK_BYTES, ROUTE_BYTES, ASK_BYTES = 8 << 20, 16 << 20, 64 << 20, 8 << 20
MODEL = "bucket int, buckets int, tokens long, distinct long, words binary, counts binary, bits long, filter binary"
MADE = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, an end after each text's words, and where each text begins (one more)."""
    data, offsets = text_bytes(column(part, text))
    _, _, hashes, firsts = spans(data, offsets, NOT_BLANK)
    starts = firsts + np.arange(len(firsts))
    out = np.full(int(starts[-1]), END, np.uint64)
    at = np.ones(len(out), bool)
    at[starts[1:] - 1] = False
    out[at] = hashes
    return out, starts


def grams_of(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 2 to order, a hash of each token and the n - 1 before it; ends stand before a text."""
    turn = np.uint64(0x9FB21C651E98DF25)
    out, last, pad = [], tokens, END
    for _ in range(order - 1):
        before = np.concatenate([[pad], last[:-1]]).astype(np.uint64)
        before[starts[:-1]] = pad
        out.append(mix(before * turn + tokens))
        with np.errstate(over="ignore"):
            pad = mix(np.array([pad * turn + END]))[0]
        last = out[-1]
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def low_bits(pairs: np.ndarray) -> np.ndarray:
    """What a bucket knows of a pair: 40 bits."""
    return pairs & np.uint64(0xFFFFFFFFFF)


class Groups:
    """Values group by group: `order` are their places, in the order in which they were within a group; groups are those that have values."""

    def __init__(self, group: np.ndarray):
        narrow = group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group  # these are sorted by counting
        self.order = np.argsort(narrow, kind="stable")
        self.sorted = group[self.order]
        self.groups = self.sorted[np.flatnonzero(np.append(True, self.sorted[1:] != self.sorted[:-1]))] if len(group) else group

    def ends(self, some: np.ndarray) -> np.ndarray:
        """Where each of some groups begins, and where the last ends; some holds all groups that have values."""
        return np.append(np.searchsorted(self.sorted, some), len(self.sorted))


def low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The `width` low bytes of each value, a row each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def from_low_bytes(data: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.reshape(-1).view("<u8").astype(np.uint64)


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of values[ends[i] : ends[i + 1]] as the i-th value of a binary column."""
    offsets = (ends * (values.nbytes // max(len(values), 1))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def probes_of(level: int, probes: int) -> int:
    return probes if level == 1 else max(1, probes // 2)


def filter_bits(levels: np.ndarray, probes: int) -> int:
    """Bits for n-grams of these levels, half of them set at the end."""
    keys = len(levels) * probes + int((levels - 1).sum()) * probes_of(2, probes)
    return max(64, int(keys / np.log(2)))


def hashed(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of (n-gram, level) begin, and their step."""
    h = mix(grams + np.uint64((level * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
    return h, mix(h) | np.uint64(1)


def place(h: np.ndarray, step: np.ndarray, i: int, bits: np.ndarray | int) -> np.ndarray:
    return (((h + step * np.uint64(i)) >> np.uint64(8)) % np.asarray(bits, np.uint64)).astype(np.int64)


def build(train: DataFrame, *, text: str = "text", order: int = ORDER, probes: int = PROBES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The model of the texts of train as a written table, a row for each bucket: token counts, exact unigram counts (sorted word hashes) and the filter of its n-grams. Null texts are empty; no rows give an empty table."""
    train = train.select(frames.named(text).cast("string").alias("body"))
    size = train.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + 1)).first()[0] or 0
    buckets = int(size // bucket_bytes) + 1

    def count(batches):
        def pack(found):
            """A row for each bucket that has something of these texts."""
            own = []
            for values in (np.concatenate(x) for x in zip(*found, strict=True)):
                values, n = np.unique(values, return_counts=True)
                own.append((values, Groups(bucket_of(values, buckets)), n.astype("<u4")))
            (w, at_w, c), (p, at_p, q) = own
            some = np.union1d(at_w.groups, at_p.groups)
            ends_w, ends_p = at_w.ends(some), at_p.ends(some)
            packed = low_bytes(p[at_p.order], 5)
            columns = [pa.array(some, pa.int32()), binaries(w[at_w.order].astype("<u8"), ends_w), binaries(c[at_w.order], ends_w), binaries(packed, ends_p), binaries(q[at_p.order], ends_p)]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "words", "counts", "pairs", "times"])

        found, held = [], 0
        for part in pieces(batches, "body"):
            tokens, starts = tokens_of(part, "body")
            found.append((tokens, np.concatenate([END[None][:0], *grams_of(tokens, starts, order)])))
            held += part.nbytes
            if held >= PACK_BYTES:
                yield pack(found)
                found, held = [], 0
        if found:
            yield pack(found)

    def total(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, times = np.concatenate(keys), np.concatenate(times).astype(np.int64)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[head], np.add.reduceat(times, head) if len(head) else times

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        words, counts = total([np.frombuffer(x, "<u8") for x in rows["words"]], [np.frombuffer(x, "<u4") for x in rows["counts"]])
        pairs, times = total([from_low_bytes(x, 5) for x in rows["pairs"]], [np.frombuffer(x, "<u4") for x in rows["times"]])
        level = np.frexp(times.astype(np.float64))[1]  # 1 + floor(log2)
        bits = filter_bits(level, probes)
        on = np.zeros(bits, np.uint8)
        for j in range(1, int(level.max(initial=0)) + 1):
            h, step = hashed(pairs[level >= j], j)
            for i in range(probes_of(j, probes)):
                on[place(h, step, i, bits)] = 1
        return pd.DataFrame([{"bucket": rows["bucket"].iloc[0], "buckets": buckets, "tokens": int(counts.sum()), "distinct": len(words), "words": words.tobytes(), "counts": counts.astype("<i8").tobytes(), "bits": bits, "filter": np.packbits(on, bitorder="little").tobytes()}])

    counted = train.mapInArrow(count, "bucket int, words binary, counts binary, pairs binary, times binary")
    return written(counted.groupBy("bucket").applyInPandas(merge, MODEL), "language-model")


class Slice:
    """The buckets of a route in memory, by their numbers within it (bucket // routes)."""

    def __init__(self, rows, buckets: int, probes: int):
        self.probes = probes
        words, counts, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], bytearray(1)
        self.bits, self.first, self.here = np.ones(buckets, np.uint64), np.zeros(buckets, np.int64), np.zeros(buckets, bool)
        for r in rows:  # one at a time: only their contents stay
            words.append(np.frombuffer(r["words"], "<u8"))
            counts.append(np.frombuffer(r["counts"], "<i8"))
            self.bits[r["bucket"]], self.first[r["bucket"]], self.here[r["bucket"]] = r["bits"], len(held), True
            held += r["filter"]
        self.filter = np.frombuffer(held, np.uint8)
        words, counts = np.concatenate(words), np.concatenate(counts)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """The training count of each token, 0 for those that other buckets hold."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64)
        distinct, inverse = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        return np.where(self.words[at] == distinct, self.counts[at], 0)[inverse]

    def level(self, low: np.ndarray, bucket: np.ndarray, caps: np.ndarray) -> np.ndarray:
        """The level of each n-gram (its low bits and its bucket), its cap at most: how many levels in a row are found; 0 for those that other buckets hold."""
        out = np.zeros(len(low), np.int8)
        at = np.flatnonzero(self.here[bucket] & (caps > 0))
        j = 0
        while len(at):
            j += 1
            h, step = hashed(low[at], j)
            bits, first = self.bits[bucket[at]], self.first[bucket[at]]
            for i in range(probes_of(j, self.probes)):
                p = place(h, step, i, bits)
                yes = (self.filter[first + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
                at, h, step, bits, first = at[yes], h[yes], step[yes], bits[yes], first[yes]
            out[at] = j
            at = at[caps[at] > j]
        return out


def levels_of(grams: list[np.ndarray], starts: np.ndarray, counts: np.ndarray, look) -> list[np.ndarray]:
    """The levels of the n-grams of each order. look(k, grams, caps): what the filter says, with its caps kept or not."""
    if not len(counts):
        return [np.zeros(0, np.int8) for _ in grams]
    most = lambda n: np.frexp(n.astype(np.float64))[1]  # the level of a count
    ends = int(most(counts[starts[1:2] - 1])[0])
    own, out = most(counts), []
    for k, g in enumerate(grams):
        before = np.concatenate([[0], own[:-1]])
        before[starts[:-1]] = ends
        caps = np.minimum(before, own)
        own = np.minimum(look(k, g, caps), caps)
        out.append(own)
    return out


def scored(part: pa.RecordBatch | pa.Table, tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray, levels: list[np.ndarray], total: int, distinct: int, weight: float) -> list[pa.Array]:
    """The columns of MADE."""
    one = (counts + 1) / (total + distinct + 1)
    p = one
    if len(tokens):
        ends = counts[starts[1] - 1]
        largest = counts.astype(np.float64)
        for level in levels:
            context = np.concatenate([[0.0], largest[:-1]])
            context[starts[:-1]] = ends
            share = np.where(context > 0, weight, 0.0)
            least = np.where(level > 0, np.exp2(level.astype(np.float64) - 1), 0.0)
            p = share * np.minimum(least / np.maximum(context, 1), 1.0) + (1 - share) * p
            largest = np.where(level > 0, np.exp2(level.astype(np.float64)) - 1, 0.0)
    add = lambda x: np.add.reduceat(x, starts[:-1]) if len(x) else np.zeros(0)
    known = add((counts > 0).astype(np.int64)).astype(np.int64)
    return [pa.array(np.diff(starts)), pa.array(known), pa.array(np.full(part.num_rows, total, np.int64)), pa.array(add(np.log10(one)).astype(np.float64)), pa.array(add(np.log10(p)).astype(np.float64))]


def score(docs: DataFrame, model: DataFrame, *, text: str = "text", order: int = ORDER, probes: int = PROBES, weight: float = WEIGHT, route_bytes: int = ROUTE_BYTES) -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score (log10).

    model: what build() gave, with the same order and probes. Null and empty texts are one token, the end. An
    empty model knows nothing: base_score is 0 and score too. Very long texts are scored as a whole. Repeated
    rows and other columns stay (those of the names above are replaced; rows that are equal in all columns are
    looked up together); an empty table stays empty.

    Texts ask in packs, and a row's hash says which pack it's in, so the packs are the same whenever they're
    read. Routes are groups of buckets (bucket = route + routes * k, k under 256), each in memory in one task at
    a time. A pack asks each route that it has something of once, for distinct words and n-grams, and gets
    counts and levels in the order in which it asked. All of it grows with the number of tokens.
    """
    made = T.StructType.fromDDL(MADE).fields
    rows, fields, names = frames.carried(docs, text, [f.name for f in made], keep_text=False)
    schema = T.StructType([*fields, *made])
    size = F.octet_length("words") + F.octet_length("counts") + F.octet_length("filter")
    known = model.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.max("buckets").alias("b"), F.sum(size.cast("long")).alias("size")).first()
    total, distinct, buckets = known.n or 0, known.v or 0, known.b or 1
    asking = rows.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)).cast("long"))).first()[0] or 0
    packs = int(asking // ASK_BYTES) + 1
    routes = min(buckets, max(int(max(asking, known.size or 0) // route_bytes) + 1, -(-buckets // 256)))
    plain = [F.col(f.name) for f in rows.schema.fields if not isinstance(f.dataType, T.MapType | T.ArrayType | T.StructType | T.VariantType)]
    texts = rows.withColumn("pack", F.pmod(F.xxhash64(*plain), F.lit(packs)))
    route_of = lambda values: bucket_of(values, buckets) % routes

    def asked_by(table: pa.Table):
        """The tokens of a pack, where its texts begin, its n-grams; its distinct words and n-grams, and which of them each one is."""
        found = [tokens_of(part, "body") for part in pieces(table.select(["body"]).to_batches(), "body")]  # hashing takes many bytes for each byte of text
        tokens, lengths = np.concatenate([t for t, _ in found]), np.concatenate([np.diff(s) for _, s in found])
        starts = np.append(0, np.cumsum(lengths))
        grams = grams_of(tokens, starts, order)
        words, word = np.unique(tokens, return_inverse=True)
        wanted, gram = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]), return_inverse=True)
        return tokens, starts, grams, words, word, wanted, gram

    def ask(table: pa.Table) -> pa.Table:
        _, _, _, words, _, wanted, _ = asked_by(table)
        by_word, by_gram = Groups(route_of(words)), Groups(route_of(wanted))
        some = np.union1d(by_word.groups, by_gram.groups)
        local = (bucket_of(wanted, buckets) // routes).astype(np.uint64)
        packed = low_bytes((low_bits(wanted) | local << np.uint64(40))[by_gram.order], 6)
        columns = [pa.array(some, pa.int32()), pa.array(np.full(len(some), table["pack"][0].as_py(), np.int64)), binaries(words[by_word.order], by_word.ends(some)), binaries(packed, by_gram.ends(some))]
        return pa.Table.from_arrays(columns, ["route", "pack", "words", "grams"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        use = Slice(({**r, "bucket": r["bucket"] // routes} for b in held.to_batches(max_chunksize=1) for r in b.to_pylist()), -(-buckets // routes), probes)
        out = []
        for part in pieces(asked.to_batches(), "grams"):
            words, grams = column(part, "words").to_pylist(), column(part, "grams").to_pylist()
            g = from_low_bytes(b"".join(grams), 6)
            counts = use.count(np.frombuffer(b"".join(words), np.uint64)).astype("<i8")
            levels = use.level(low_bits(g), (g >> np.uint64(40)).astype(np.int64), np.full(len(g), 64))
            ends = lambda values, width: np.append(0, np.cumsum([len(x) // width for x in values])).astype(np.int64)
            out.append(pa.RecordBatch.from_arrays([column(part, "pack"), column(part, "route"), binaries(counts, ends(words, 8)), binaries(levels, ends(grams, 6))], ["pack", "route", "counts", "levels"]))
        return pa.Table.from_batches(out, schema=pa.schema([("pack", pa.int64()), ("route", pa.int32()), ("counts", pa.binary()), ("levels", pa.binary())]))

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, starts, grams, words, word, wanted, gram = asked_by(left)
        right = right.sort_by("route")  # as it was asked

        def found(values: np.ndarray, name: str, kind) -> np.ndarray:
            out = np.zeros(len(values), kind)
            if right.num_rows:  # an empty model answers nothing
                out[Groups(route_of(values)).order] = np.frombuffer(b"".join(right[name].to_pylist()), kind)
            return out

        counts = found(words, "counts", np.int64)[word]
        raw = np.split(found(wanted, "levels", np.int8)[gram], len(grams)) if grams else []
        levels = levels_of(grams, starts, counts, lambda k, g, caps: raw[k])
        columns = [*(left.column(f.name) for f in fields), *scored(left, tokens, starts, counts, levels, total, distinct, weight)]
        return pa.Table.from_arrays(columns, schema.names)

    asked = texts.select("pack", "body").groupBy("pack").applyInArrow(ask, "route int, pack long, words binary, grams binary")
    held = model.withColumn("route", F.col("bucket") % routes)
    answered = asked.groupBy("route").cogroup(held.groupBy("route")).applyInArrow(answer, "pack long, route int, counts binary, levels binary")
    answered = written(answered, "language-model-answers")
    return texts.groupBy("pack").cogroup(answered.groupBy("pack")).applyInArrow(together, schema).toDF(*names, *[f.name for f in made])


def held_out(id_col: str, n: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves `part`; false for a null id."""
    return F.coalesce(F.crc32(frames.named(id_col).cast("string").cast("binary")) % n == part, F.lit(False))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those that aren't held out."""
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return score(docs, build(docs.where(~F.col("held_out"))))
