"""Operator 10: benchmark decontamination with suffix arrays over the training words.

A task turns each piece of documents (a shard) into an array of word ranks with a separator after each
document, and sorts the suffixes by their first `window` words: prefix doubling names every run of 1, 2, 4, ...
words so that names sort as the runs do. Every distinct window of the benchmark items is looked up by binary search
in the names of each level, which ends in a range of the suffix array: all places where it stands. Ranges of
distinct windows don't overlap, so that marking the places costs no more than the shard, however often an item
repeats a window. Longest verbatim matches are cut from the ranges too: they begin where the words before a place in
a document and before its partner in an item differ, and end where those after them do.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .frames import Scratch, column, pieces, ragged, text_bytes
from .pretoken import mix
from .words import ALNUM, shingles, spans

WINDOW = 10
#: Bytes of item texts that are sent to all workers at once; more items are taken in blocks of this size.
ITEM_BYTES = 32 << 20
#: Bytes of text in a shard, whose suffix array all item suffixes are looked up in; a longer single text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Parts into which items are dealt for each block of them, so that blocks can be cut by size.
PARTS = 64
SPAN = "array<struct<item:string,item_word:int,doc_word:int,length:int>>"
#: What goes from one block of items to the next: the parts of a document that are hit, and the items found.
STATE = "hits array<struct<at:int,length:int>>, found array<string>"


class Items:
    """Words of distinct item texts one after the other, a separator after each; their distinct windows, and which texts have each.

    ids: the ids of each text. Window u stands at place[u] (and elsewhere), has length[u] words, and the texts of
    class kind[u]; members[c] are the texts of a class.
    """

    def __init__(self, ids: list[list[str]], texts: list[str], window: int):
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        _, _, hashes, firsts = spans(data, offsets, ALNUM)
        counts = np.diff(firsts)
        self.ids, self.hashes, self.window = ids, hashes, window
        self.at = np.arange(len(hashes)) + np.repeat(np.arange(len(ids)), counts)  # the place in the array with separators
        self.size = len(hashes) + len(ids)
        self.first = firsts[:-1] + np.arange(len(ids))
        found, before = shingles(hashes, firsts, window)
        n = np.diff(before)
        text = np.repeat(np.arange(len(ids)), n)
        where = self.first[text] + np.arange(len(found)) - before[:-1][text]
        _, one, unit = np.unique(found, return_index=True, return_inverse=True)
        self.place, self.length = where[one], np.minimum(counts[text[one]], window)
        by_unit = np.argsort(unit, kind="stable")
        self.standing, self.edges = where[by_unit], np.searchsorted(unit[by_unit], np.arange(len(one) + 1))
        self.text_at = text[by_unit]
        # the texts of each window, each once; windows of the same texts are of one class
        pairs = np.unique(unit.astype(np.int64) * max(1, len(ids)) + text)
        u, t = np.divmod(pairs, max(1, len(ids)))
        heads = np.searchsorted(u, np.arange(len(one)))
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(t.astype(np.uint64) + np.uint64(1)), heads)) if len(one) else np.empty(0, np.uint64)
        _, first, self.kind = np.unique(name, return_index=True, return_inverse=True)
        ends = np.append(heads[1:], len(u))
        self.members = [t[heads[i] : ends[i]].tolist() for i in first.tolist()]


def ranks_of(table: np.ndarray, keys: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 for those that aren't there or aren't ok."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(ok & (table[at] == keys), at, -1)


def shifted(names: np.ndarray, by: int, fill: int) -> np.ndarray:
    return np.concatenate([names[by:], np.full(min(by, len(names)), fill, names.dtype)])


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range low to high, in which values are sorted, the range of those equal to x; many binary searches at once."""

    def bound(beyond: Callable) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while (on := a < b).any():
            mid = (a + b) // 2
            up = beyond(values[np.minimum(mid, len(values) - 1)])
            a, b = np.where(on & up, mid + 1, a), np.where(on & ~up, mid, b)
        return a

    return bound(lambda v: v < x), bound(lambda v: v <= x)


class Shard:
    """The suffix array of a piece of documents. Places count the separators."""

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray, window: int):
        counts, docs = np.diff(firsts), len(firsts) - 1
        self.window, self.size = window, len(hashes) + docs
        self.starts = firsts[:-1] + np.arange(docs)
        self.doc = np.repeat(np.arange(docs), counts + 1)
        self.table, names = np.unique(hashes, return_inverse=True)
        self.words = np.zeros(self.size, np.int64)
        self.words[np.arange(len(hashes)) + np.repeat(np.arange(docs), counts)] = names + 1
        self.levels, names, length = [], self.words, 1
        while length < window:  # names of `length` words to those of twice as many, or of the window
            by = min(length, window - length)
            base = int(names.max(initial=0)) + 1
            keys, table = names * base + shifted(names, by, 0), None
            length += by
            if length < window:
                table, keys = np.unique(keys, return_inverse=True)
            self.levels.append((by, base, table))
            names = keys
        self.names = names
        self.order = np.argsort(names, kind="stable")
        self.sorted = names[self.order]

    def item_words(self, items: Items) -> np.ndarray:
        """The items' words by the shard's names, -1 for words that it lacks and for separators."""
        out = np.full(items.size, -1)
        rank = ranks_of(self.table, items.hashes, np.ones(len(items.hashes), bool))
        out[items.at] = np.where(rank >= 0, rank + 1, -1)
        return out

    def ranges(self, items: Items, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the range of each of the items' distinct windows begins in the suffix array, and how long it is."""
        names = words
        for by, base, table in self.levels:
            ahead = shifted(names, by, -1)
            names = np.where((names >= 0) & (ahead >= 0), names * base + ahead, -1)
            if table is not None:
                names = ranks_of(table, names, names >= 0)
        wanted = np.where(items.length == self.window, names[items.place], -1)
        low = np.searchsorted(self.sorted, wanted, "left")
        n = np.where(wanted >= 0, np.searchsorted(self.sorted, wanted, "right") - low, 0)
        short = np.flatnonzero(items.length < self.window)
        if len(short) and self.size:  # narrowed word by word
            a, b = np.zeros(len(short), np.int64), np.full(len(short), self.size)
            for k in range(int(items.length[short].max())):
                on = items.length[short] > k
                a[on], b[on] = within(shifted(self.words, k, 0)[self.order], a[on], b[on], words[items.place[short][on] + k])
            low[short], n[short] = a, b - a
        return low, n

    def spans(self, items: Items, words: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All longest matches of at least a window (or a whole shorter item): text, first word in it, place in the shard, words."""

        def edges(ours: np.ndarray, step: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The places and item places of windows in ranges `whole` whose words beside them differ. ours: the word beside each place."""
            order = np.lexsort((ours, self.names))
            u = np.repeat(whole, np.diff(items.edges)[whole])
            q = items.standing[ragged(items.edges[whole], np.diff(items.edges)[whole])]
            beside = q + step
            theirs = np.where((beside >= 0) & (beside < items.size), words[np.clip(beside, 0, items.size - 1)], -1)
            a, b = within(ours[order], low[u], low[u] + n[u], theirs)
            begin, count = np.concatenate([low[u], b]), np.concatenate([a - low[u], low[u] + n[u] - b])
            return order[ragged(begin, count)], np.repeat(np.concatenate([q, q]), count)

        full = np.flatnonzero((n > 0) & (items.length == self.window))
        p, q = edges(np.concatenate([[0], self.words[:-1]]) if self.size else self.words, -1, full)
        end, end_q = edges(shifted(self.words, self.window, 0), self.window, full)
        heads, ends = np.lexsort((p, p - q)), np.lexsort((end, end - end_q))  # the same diagonals, one end for each head
        p, q, length = p[heads], q[heads], end[ends] - p[heads] + self.window
        short = np.flatnonzero((n > 0) & (items.length < self.window))
        times = np.diff(items.edges)[short]
        u, begins = np.repeat(short, times), items.standing[ragged(items.edges[short], times)]
        p = np.concatenate([p, self.order[ragged(low[u], n[u])]])
        q, length = np.concatenate([q, np.repeat(begins, n[u])]), np.concatenate([length, np.repeat(items.length[u], n[u])])
        text = np.searchsorted(items.first, q, "right") - 1 if len(q) else np.empty(0, np.int64)
        return text, q - items.first[text], p, length


def blocks(items: DataFrame, item_bytes: int, scratch: Scratch) -> Iterator[tuple[list[list[str]], list[str], bool]]:
    """Distinct texts of items (item_id, text) and their ids, in blocks of about item_bytes, and whether a block is the last; the driver has one at a time.

    Texts are dealt into small parts by hash, and parts are put together by their sizes; a part of its own may be
    larger only for a single text (or ids of one text) of that size.
    """
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    distinct = items.where("text is not null").groupBy("text").agg(F.collect_set("item_id").alias("ids"))
    weigh = size("text") + F.aggregate("ids", F.lit(0), lambda a, x: a + F.octet_length(x)) + 16
    total = items.agg(F.sum(size("text") + size("item_id") + 16)).first()[0] or 0
    parts = (int(total // item_bytes) + 1) * PARTS if total > item_bytes else 1
    dealt = scratch.written(distinct.select("ids", "text", weigh.alias("bytes"), F.pmod(F.xxhash64("text"), F.lit(parts)).alias("part")), "items")
    sizes = dealt.groupBy("part").agg(F.sum("bytes").alias("bytes")).orderBy("part").collect()  # PARTS for each block
    cuts, held = [], 0
    for r in sizes:
        if not cuts or held + r.bytes > item_bytes:
            cuts.append([r.part, r.part])
            held = 0
        cuts[-1][1] = r.part
        held += r.bytes
    for a, b in cuts:
        got = dealt.where(F.col("part").between(a, b)).collect()
        yield [sorted(r.ids) for r in got], [r.text for r in got], (a, b) == tuple(cuts[-1])
    if not cuts:
        yield [], [], True


def contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, with_spans: bool = True, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and, with_spans, the longest verbatim matches of at least a window (item, first word in item and document, words).

    Documents aren't shuffled: each is in one shard as a whole. Items up to item_bytes go to all workers; more
    go block by block, and what the blocks find is put together. Items of equal texts are looked up once. Null and
    empty texts have no words and no hits; null item ids count as one item named ''; items of one id count as one;
    a document's other columns and repeated rows stay; an empty table on either side is fine. Memory follows the
    words of a shard and of a block of items; with spans also their number, which can be the product of how often a
    window stands in a document and in an item, if what stands beside it differs each time.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    scratch = Scratch(docs.sparkSession, "contamination")
    rows = items.select(F.coalesce(frames.named(item_id).cast("string"), F.lit("")).alias("item_id"), frames.named(item_text).cast("string").alias("text"))
    out, fields, names = frames.carried(docs, text, made)
    own = [f.name for f in fields]
    more = False
    for ids, texts, last in blocks(rows, item_bytes, scratch):
        body = "" if "body" in own else "body string, "
        ends = T.StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else body + STATE).fields
        schema = T.StructType([*fields, *ends, *([T.StructField("spans", T._parse_datatype_string(SPAN))] if with_spans else [])])
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts, uuid.uuid4().hex))
        out = out.mapInArrow(searcher(sent, own, window, with_spans, more, last), schema)
        if not last:
            out, more = frames.written(out, "contamination"), True
    return out.toDF(*names, *schema.names[len(fields) :])


def held_items(sent, window: int) -> Items:
    """The arrays of a block of items, kept by the worker for its next task."""
    ids, texts, name = sent.value
    return frames.remembered("items", (name, window), lambda: Items(ids, texts, window))


def searcher(sent, names: list[str], window: int, keep: bool, more: bool, last: bool):
    def run(batches):
        items = held_items(sent, window)
        for part in pieces(batches, "body", SHARD_BYTES):
            data, offsets = text_bytes(column(part, "body"))
            _, _, hashes, firsts = spans(data, offsets, ALNUM)
            docs, counts = part.num_rows, np.diff(firsts)
            shard = Shard(hashes, firsts, window)
            words = shard.item_words(items)
            low, n = shard.ranges(items, words)
            unit = np.flatnonzero(n)
            where, unit = shard.order[ragged(low[unit], n[unit])], np.repeat(unit, n[unit])
            length = items.length[unit]
            change = np.zeros(shard.size + 1, np.int64)
            change += np.bincount(where, minlength=len(change)) - np.bincount(where + length, minlength=len(change))
            if more:
                hits = column(part, "hits")
                at = np.repeat(shard.starts, hits.value_lengths().to_numpy(zero_copy_only=False)) + hits.flatten().field("at").to_numpy()
                to = at + hits.flatten().field("length").to_numpy()
                change += np.bincount(at, minlength=len(change)) - np.bincount(to, minlength=len(change))
            inside = np.cumsum(change[:-1]) > 0
            covered = np.concatenate([[0], np.cumsum(inside)])
            n_hit = covered[shard.starts + counts] - covered[shard.starts]
            found: list[set[str]] = [set(x) for x in column(part, "found").to_pylist()] if more else [set() for _ in range(docs)]
            kinds = max(1, len(items.members))
            for x in np.unique(shard.doc[where] * kinds + items.kind[unit]).tolist():
                for t in items.members[x % kinds]:
                    found[x // kinds].update(items.ids[t])
            own = [column(part, c) for c in names]
            if last:
                ordered = [sorted(x) for x in found]
                shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ordered]
                cols = [*own, pa.array(counts), pa.array(n_hit.astype(np.int64)), pa.array(list(map(len, found)), pa.int64()), pa.array(shas, pa.string()), pa.array(n_hit > 0)]
                called = [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            else:
                edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                by_doc = np.searchsorted(shard.doc[a], np.arange(docs + 1))
                runs = pa.StructArray.from_arrays([pa.array((x).astype(np.int32)) for x in (a - shard.starts[shard.doc[a]] if docs else a, b - a)], ["at", "length"])
                body = [] if "body" in names else ["body"]
                cols = [*own, *(column(part, c) for c in body), pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), runs), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                called = [*names, *body, "hits", "found"]
            if keep:
                text, item_word, place, length = shard.spans(items, words, low, n)
                each = np.array([len(x) for x in items.ids], np.int64)[text] if len(text) else text
                name = [i for t in text.tolist() for i in items.ids[t]]
                item_word, place, length = (np.repeat(x, each) for x in (item_word, place, length))
                doc = shard.doc[place]
                doc_word = place - shard.starts[doc] if docs else place
                if more:
                    old = column(part, "spans")
                    flat = old.flatten()
                    doc = np.concatenate([doc, np.repeat(np.arange(docs), old.value_lengths().to_numpy(zero_copy_only=False))])
                    name += flat.field("item").to_pylist()
                    item_word, doc_word, length = (np.concatenate([x, flat.field(c).to_numpy()]) for x, c in ((item_word, "item_word"), (doc_word, "doc_word"), (length, "length")))
                order = np.lexsort((doc_word, doc))
                flat = pa.StructArray.from_arrays([pa.array([name[i] for i in order.tolist()], pa.string()), *(pa.array(x[order].astype(np.int32)) for x in (item_word, doc_word, length))], ["item", "item_word", "doc_word", "length"])
                cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(docs + 1)).astype(np.int32)), flat))
                called = [*called, "spans"]
            yield pa.RecordBatch.from_arrays(cols, called)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents in which an item's window occurs; the columns stay as they are."""
    marked = contamination(docs, items, with_spans=False, **options)
    return marked.where(~F.col("contaminated")).select(*[frames.named(c) for c in docs.columns])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs, items = frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark")
    return contamination(docs.select("doc_id", "text"), items, with_spans=False).drop("text")


#: op10_decontamination in DuckDB: a join of the windows of items with the runs of as many words of documents.
SQL = r"""WITH d AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, size, array_to_string(w[p : p + size - 1], ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM v),
t AS (SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, z WHERE len(w) >= size)),
h AS (SELECT t.doc_id, t.p, t.size, v.item FROM t JOIN v ON t.size = v.size AND t.g = v.g),
k AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, coalesce(m.sha, sha256('')) AS items_sha256, coalesce(k.n, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""
