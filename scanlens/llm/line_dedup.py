"""Operator 6: fuzzy line deduplication by MinHash, with DataFrame functions only.

A line is the set of its character shingles. A signature has MINS values: the hash of a shingle that comes
nearest (by XOR) to each of as many fixed masks, as chance picks one of the line's shingles for each. Signatures
are made without a shuffle of texts: a row for each chunk of CHUNK shingles, whose hashes are columns, and a
minimum per line. Four values make a band; the bands are the lines of the plane of order 4, so that any two
values are together in one band. Lines that share a band's key are candidates.

Candidates are compared by bit sketches first (a bit for each shingle's hash; bits that differ are at most the
shingles that differ), then exactly: each line of a key with the key's least one, and, for keys whose lines are
still of different components, all those with each other. Large keys are joined with themselves in blocks, by sketches:
first each line is compared with the nearest one of another component, then all that are of different components still. Connected
components of the links keep one line each: the first one by document id and line number. Lines that are equal are
one line from the start.

The search for links knows lines by 64-bit hashes: of different lines with the same hash one is looked at for links.
What goes is known by 128 bits: a line goes only if its second hash, too, is that of a linked line or of a repeat.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .components import components, joined_components
from .frames import BROADCAST_ROWS, Scratch, small

#: Characters (UTF-16 units) of a shingle, similarity in percent.
SHINGLE, PERCENT = 7, 80
#: Longs of the sketches that lines of large keys are compared by.
FINE = 64
#: Numbers that a band's own can be, in the last bits of its keys.
BANDS = 32
#: Values of a signature (the points of a plane of order 4), longs of a sketch, shingles of a chunk, lines of a key whose pairs are all listed, most lines of a block of a larger key.
MINS, WORDS, CHUNK, FEW, BLOCK = 16, 32, 8, 20, 512
#: Characters of a block's lines, in the mean; a longer line is a block of its own. It bounds what one pair of blocks hands on to the exact comparison.
BLOCK_CHARS = 1 << 20
#: The seed of second hashes.
SECOND = 1
#: What a blank line is made of.
BLANK = " \t\r\f\v"


def row_key(id_col: str, text: str) -> Column:
    """What a document is known by, of 128 bits: rows of the same id and text are one document."""
    parts = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(SECOND), *parts).alias("b"))


def line_hash(line: Column) -> Column:
    """What the search for links knows a line by."""
    return F.xxhash64(line)


def second_hash(line: Column) -> Column:
    """A hash from another seed (a seed comes first: put last, it would collide where line_hash does)."""
    return F.xxhash64(F.lit(SECOND), line)


def masks() -> list[int]:
    """Two halves of masks, as signed longs; in each half they differ in the first three bits."""
    out = []
    for k in range(MINS):
        tail = int.from_bytes(hashlib.sha256(f"mask {k}".encode()).digest()[:8], "big") >> 3
        value = (k % (MINS // 2)) << 61 | tail
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def plane() -> list[list[int]]:
    """The 20 lines of the affine plane of order 4 on the points 0 to 15: each pair of points is on one of them."""
    times = [[0, 0, 0, 0], [0, 1, 2, 3], [0, 2, 3, 1], [0, 3, 1, 2]]  # the field of four elements; its sum is XOR
    slopes = [[4 * x + (times[m][x] ^ c) for x in range(4)] for m in range(4) for c in range(4)]
    return slopes + [[4 * x + y for y in range(4)] for x in range(4)]


def units(line: Column) -> Column:
    """The line as 2 bytes a unit, so that a shingle is a slice at a known place."""
    return F.encode(line, "UTF-16BE")


def shingle_at(u: Column, at: Column, last: Column) -> Column:
    """The hash of the shingle at a byte (from 1), or of the last one."""
    return F.xxhash64(F.substring(u, F.least(at, last), F.lit(2 * SHINGLE)))


def chunks(lines: DataFrame, size: int) -> DataFrame:
    """(h, n, x0, x1, ...): the hashes of `size` of the n shingles of a line (h, line) in each row; the last ones repeat at its end."""
    rows = lines.select("h", units(F.col("line")).alias("u")).withColumn("last", F.octet_length("u") - 2 * SHINGLE + 1).where("last > 0")
    rows = rows.select("h", "u", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * size))).alias("at"))
    return rows.select("h", ((F.col("last") + 1) / 2).cast("int").alias("n"), *[shingle_at(F.col("u"), F.col("at") + 2 * j, F.col("last")).alias(f"x{j}") for j in range(size)])


def lines_of(docs: DataFrame, text: str) -> DataFrame:
    """(line, h) of all documents."""
    return docs.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("line")).withColumn("h", line_hash(F.col("line")))


def signatures(lines: DataFrame) -> DataFrame:
    """(h, m0, m1, ...) of the lines (h, line) that have a shingle. (A chunk's minima are columns below the aggregate; more shingles a chunk make methods that Java compiles badly.)"""
    turned = [F.expr(f"shiftleft(x{j}, 32) | shiftrightunsigned(x{j}, 32)").alias(f"y{j}") for j in range(CHUNK)]
    rows = chunks(lines, CHUNK).select("h", *[f"x{j}" for j in range(CHUNK)], *turned)
    near = lambda k, mask: F.least(*[F.col(f"{'xy'[k >= MINS // 2]}{j}").bitwiseXOR(F.lit(mask)) for j in range(CHUNK)])
    rows = rows.select("h", *[near(k, mask).alias(f"m{k}") for k, mask in enumerate(masks())])
    return rows.groupBy("h").agg(*[F.min(f"m{k}").alias(f"m{k}") for k in range(MINS)])


def bands(signed: DataFrame) -> DataFrame:
    """(key, h): a key for each band of a line; its last bits are the band's number."""
    own = lambda b, points: F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in points])
    keys = F.array(*[own(b, points).bitwiseAND(F.lit(-BANDS)).bitwiseOR(F.lit(b)) for b, points in enumerate(plane())])
    return signed.select(F.explode(keys).alias("key"), "h")


def key_members(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, h): the lines of each key that several share; keys of the same lines are one key, that of the first band."""
    shared = bands(signed).groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("h")).alias("same")).where("many > 1")
    one = scratch.written(shared.groupBy("many", "same").agg(F.min(F.struct(F.col("key").bitwiseAND(F.lit(BANDS - 1)).alias("band"), "key")).alias("first")).select("first.key"), "shared")
    members = scratch.written(bands(signed).join(small(one), "key", "left_semi").select("key", "h"), "members")
    scratch.drop(one)
    return members


def sketches(lines: DataFrame, words: int = WORDS, first: int = 0) -> DataFrame:
    """(h, n, w0, w1, ...): the number of shingles (repeated ones count) and the sketch of distinct lines (h, line); of a sketch of more words, WORDS from the first."""
    numbers = range(first, first + WORDS)
    words = [F.col(f"x{j}").bitwiseAND(F.lit(words - 1)).alias(f"w{j}") for j in range(CHUNK)]
    bits = [F.expr(f"cast(shiftrightunsigned(x{j}, 8) & 63 AS int)").alias(f"b{j}") for j in range(CHUNK)]
    rows = chunks(lines, CHUNK).select("h", "n", *words, *bits)

    def word(k: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(CHUNK):
            out = out.bitwiseOR(F.expr(f"shiftleft(cast(w{j} = {k} AS long), b{j})"))
        return F.bit_or(out)

    return rows.groupBy("h").agg(F.max("n").alias("n"), *[word(k).alias(f"w{k}") for k in numbers])


def fine_nodes(lines: DataFrame, signed: DataFrame) -> DataFrame:
    """(h, n, w0, w1, ..., m0, m1, ...) of lines of large keys: the number of distinct shingles, a sketch of FINE words, and the minima (h, m0, m1, ...)."""
    out = lines.select("h", F.size(F.array_distinct(shingle_set(F.col("line")))).alias("n"))
    for first in range(0, FINE, WORDS):  # in one aggregate they would make a method that Java doesn't compile
        out = out.join(sketches(lines, FINE, first).drop("n"), "h")
    return out.join(signed, "h")


def shingle_set(line: Column) -> Column:
    """The shingles of a line, as hashes; some may repeat. (The outer lambda binds the units, or they would be made for every shingle.)"""
    places = lambda u: F.sequence(F.lit(1), F.octet_length(u) - 2 * SHINGLE + 1, F.lit(2))
    hashes = lambda u: F.transform(places(u), lambda at: F.xxhash64(F.substring(u, at, F.lit(2 * SHINGLE))))
    return F.get(F.transform(F.array(units(line)), hashes), F.lit(0))


def apart(a, b, words: int = WORDS) -> Column:
    """How many bits of the sketches (fields w0, w1, ...) of two lines differ."""
    out = F.lit(0)
    for k in range(words):
        out = out + F.bit_count(a(f"w{k}").bitwiseXOR(b(f"w{k}")))
    return out


def most_apart(n: Column, m: Column) -> Column:
    """Bits that differ at most in sketches of lines of n and m shingles that link: linked sets differ in (100 - PERCENT) / (100 + PERCENT) of their sizes at most."""
    return F.floor((100 - PERCENT) * (n + m) / F.lit(100 + PERCENT))


def close_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of lines, a written table, whose sketches don't rule a link out."""
    named = lambda side: nodes.select(F.col("h").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in nodes.columns if c != "h"])
    one = named("b").join(small(pairs), "b")
    two = named("a").join(small(pairs.select("a").distinct()), "a", "left_semi")
    close = one.join(two, "a").where(apart(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")) <= most_apart(F.col("a_n"), F.col("b_n")))
    return close.select("a", "b")


def linked_pairs(close: DataFrame, lines: DataFrame) -> DataFrame:
    """Those pairs (a, b) of lines, a written table, that link: texts are fetched for them."""
    texts = lambda side: lines.select(F.col("h").alias(side), F.col("line").alias(f"{side}_line"))
    both = texts("b").join(small(close), "b").join(texts("a").join(small(close.select("a").distinct()), "a", "left_semi"), "a")
    # the sets go through explode() so that each is made once, and compared by generated code
    both = both.select("a", "b", F.explode(F.array(F.struct(shingle_set(F.col("a_line")).alias("x"), shingle_set(F.col("b_line")).alias("y")))).alias("p"))
    return both.where(100 * F.size(F.array_intersect("p.x", "p.y")) >= PERCENT * F.size(F.array_union("p.x", "p.y"))).select("a", "b")


def star_pairs(members: DataFrame) -> DataFrame:
    """Each line of a key with the key's least one."""
    least = members.groupBy("key").agg(F.min("h").alias("a"))
    return members.join(least, "key").where("h <> a").select("a", F.col("h").alias("b")).distinct()


def mixed_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, h, root, many): the members (key, h) of keys that have lines of different components."""
    rows = members.select("key", "h").join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    return rows.join(mixed.select("key", "many"), "key").select("key", "h", "root", "many")


def few_pairs(mixed: DataFrame) -> DataFrame:
    """The pairs of lines of different components in keys of at most FEW lines."""
    rows = mixed.where(F.col("many") <= FEW)
    both = rows.select("key", F.col("h").alias("a"), F.col("root").alias("r")).join(rows.select("key", F.col("h").alias("b"), F.col("root").alias("s")), "key")
    return both.where("a < b and r <> s").select("a", "b").distinct()


def met_before(band: Column, x, y) -> Column:
    """Whether two lines (fields m0, m1, ...) share a band before this one."""
    return F.greatest(*[F.when((band > b) & _all(x(f"m{k}") == y(f"m{k}") for k in points), 1).otherwise(0) for b, points in enumerate(plane())]) == 1


def _all(conditions) -> Column:
    return functools.reduce(lambda p, q: p & q, conditions)


def block_close(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, apart): pairs of lines of different components, in keys of more than FEW lines, whose sketches don't rule a link out.

    The lines of a key are joined with each other in blocks of bounded sizes, with sketches only; what the join
    makes is such pairs. Where nodes have minima (m0, m1, ...) too, lines that share several keys come from one of
    them: the first band that they share.
    """
    rows = mixed.where(F.col("many") > FEW).join(nodes, "h")
    blocks = F.ceil(F.greatest(F.max("many") / BLOCK, F.sum("n") / BLOCK_CHARS)).cast("int")
    rows = rows.join(rows.groupBy("key").agg(blocks.alias("blocks")), "key")
    fields = ["root", *nodes.columns]
    at = F.pmod(F.xxhash64("h", F.lit(3)), F.col("blocks")).cast("int")
    # no field is null, so that generated code needs no tests for nulls in its loop
    rows = rows.select("key", at.alias("block"), "blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in fields])
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in fields]
    # (i, j) and (j, i) are one pair, i of the one side and j of the other
    one = rows.select("key", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), *side("x"))
    two = rows.select(F.col("key").alias("y_key"), F.col("block").alias("y_j"), *side("y"))
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    on = (F.col("key") == F.col("y_key")) & (F.col("j") == F.col("y_j")) & (x("root") != y("root")) & ((F.col("i") != F.col("j")) | (x("h") < y("h")))
    bits = apart(x, y, sum(c[0] == "w" for c in nodes.columns))
    on = on & (bits <= most_apart(x("n"), y("n")))
    if "m0" in fields:
        on = on & ~met_before(F.col("key").bitwiseAND(F.lit(BANDS - 1)), x, y)
    both = one.join(two, on).select(F.least(x("h"), y("h")).alias("a"), F.greatest(x("h"), y("h")).alias("b"), bits.alias("apart"))
    return both.distinct()


def nearest(close: DataFrame) -> DataFrame:
    """(a, b): the nearest b of each a among the pairs (a, b, apart)."""
    return close.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("first")).select("a", "first.b")


def block_pairs(mixed: DataFrame, nodes: DataFrame, everyone: bool) -> DataFrame:
    """(a, b) of block_close(): all, or each line's nearest one."""
    close = block_close(mixed, nodes)
    return close.select("a", "b") if everyone else nearest(close)


def still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose lines are of different components."""
    of = lambda side: small(roots).select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def line_links(docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(a, b): links between distinct lines (by h) that make all components."""
    return links_and_lines(docs, text, scratch)[0]


def links_and_lines(docs: DataFrame, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """line_links(), their components (node, root), and (h, line): the lines that have been looked at."""
    signed = scratch.written(signatures(lines_of(docs, text)), "signatures")
    members = key_members(signed, scratch)
    wanted = scratch.written(members.select("h").distinct(), "wanted")
    lines = scratch.written(lines_of(docs, text).join(small(wanted), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "lines")
    nodes = scratch.written(sketches(lines), "nodes")
    scratch.drop(wanted)
    stars = scratch.written(star_pairs(members), "stars")
    links = scratch.written(linked_pairs(scratch.written(close_pairs(stars, nodes), "close"), lines), "links")
    roots = components(links)
    # keys with lines of different components: all pairs of small ones, nearest ones of large ones
    mixed = scratch.written(mixed_members(members, roots), "mixed")
    large = scratch.written(mixed.where(F.col("many") > FEW).select("h").distinct(), "large")
    theirs = scratch.written(lines.join(small(large), "h", "left_semi"), "theirs")
    fine = scratch.written(fine_nodes(theirs, signed.join(small(large), "h", "left_semi")), "fine")
    within = scratch.written(block_close(mixed, fine), "within")
    few = scratch.written(few_pairs(mixed).join(stars, ["a", "b"], "left_anti"), "pairs")
    first = nearest(within).join(stars, ["a", "b"], "left_anti")
    close = scratch.written(close_pairs(few, nodes).unionByName(first).distinct(), "close")
    more = scratch.written(linked_pairs(close, lines), "links")
    links, roots = links.unionByName(more), joined_components(roots, more)
    # what large keys have of different components still: all pairs
    rest = still_apart(within.select("a", "b"), roots).join(stars.unionByName(close), ["a", "b"], "left_anti")
    rest = scratch.written(rest, "rest")
    if rest.limit(1).count():
        more = scratch.written(linked_pairs(rest, lines), "links")
        links, roots = links.unionByName(more), joined_components(roots, more)
    scratch.drop(signed, members, stars, mixed, large, theirs, fine, within, few, nodes)
    return links, roots, lines


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, drop): the numbers (from 0) of the lines that go, for every document (`row_key`) with any."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    _, roots, lines = links_and_lines(docs, text, scratch)
    roots = roots.where("node <> root").select(F.col("node").alias("h"), "root")
    twins = lines.select("h", second_hash(F.col("line")).alias("twin"))
    roots = roots.join(twins, "h").join(twins.select(F.col("h").alias("root"), F.col("twin").alias("root_twin")), "root")
    roots = scratch.written(roots.select("h", "twin", "root", "root_twin"), "roots")
    # the document's key is made below the explode(), or each line would hash the whole text
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text).alias("row"), F.split(F.col(f"`{text}`"), "\n").alias("lines"))
    rows = rows.select("id", "row", F.posexplode("lines").alias("at", "line"))
    rows = rows.where(F.btrim("line", F.lit(BLANK)) != "").select("id", "row", "at", line_hash(F.col("line")).alias("h"), second_hash(F.col("line")).alias("twin"))
    places = rows.join(small(roots), ["h", "twin"], "left").select("id", "row", "at", F.coalesce("root", "h").alias("line"), F.coalesce("root_twin", "twin").alias("twin"))
    places = scratch.written(places, "places")
    kept = places.groupBy("line", "twin").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "at")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = scratch.written(kept.select("line", "twin", F.col("kept.row").alias("kept_row"), F.col("kept.at").alias("kept_at")), "kept")
    gone = places.join(small(kept), ["line", "twin"]).where("row <> kept_row or at <> kept_at")
    drops = scratch.written(gone.groupBy("row").agg(F.collect_set("at").alias("drop")), "drops")
    scratch.drop(roots, places, kept)
    return drops


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text's kept lines, and n_lines and n_kept.

    A line goes if a line of its component stands earlier (by id, then by line number; rows without id last).
    Lines shorter than a shingle go if they're repeated exactly; blank ones always stay. Null texts stay null
    with 0 lines; an empty text has one empty line; rows of the same id and text are one document and get the
    same result; other columns stay (n_lines and n_kept are replaced); an empty table stays empty. Long lines
    are sets of all their shingles. What goes is known by 128-bit hashes. Of ties (lines of one id and number, in
    texts that differ) the one of the smaller hash of its document counts as first.
    """
    drops = dropped_lines(docs, id_col=id_col, text=text)
    few = (drops.agg(F.sum(F.size("drop") + 1)).first()[0] or 0) <= BROADCAST_ROWS
    drops = F.broadcast(drops) if few else drops
    names = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    body = F.col(f"`{text}`")
    # columns of our own are behind one struct, so that no name of the documents can clash with theirs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), row_key(id_col, text).alias("row"), F.split(body, "\n").alias("lines")).join(drops, "row", "left")
    body = F.col("doc")[text]
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_lines = F.when(body.isNull(), F.lit(0)).otherwise(F.coalesce(F.size("lines"), F.lit(0))).cast("long")
    n_kept = (n_lines - F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop"))).cast("long")
    return rows.select(*[(kept if c == text else F.col("doc")[c]).alias(c) for c in names], n_lines.alias("n_lines"), n_kept.alias("n_kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier line resembles; the kept text as its size and digest."""
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
