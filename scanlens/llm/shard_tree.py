"""Operator 1: a hierarchical weighted hash tree puts rows into shards.

The tree has regions, racks in them and shards in these. From the top, each level draws for every child: a hash
of (key, child) as a uniform number u gives the draw ln(u) / weight, and the largest draw wins. A child is
chosen in proportion to its weight, and a changed weight moves rows only between that child and its siblings:
movement stays in the subtrees whose weights change. A shard that is opened as a branch of its own (new region,
rack and shard) changes no other weight, so rows move into it only.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames

#: Rows of a shard that get their slots in one group (about), equal rows that are dealt out together.
GROUP_ROWS, SPAN = 200_000, 100_000
HEX = 13  # hex digits of a draw's hash: 52 bits, exact as a double
TREE = "array<struct<path:string,weight:double,racks:array<struct<path:string,weight:double,shards:array<struct<path:string,weight:double,shard:int>>>>>>"


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(regions: int, racks: int, shards: int) -> list[Shard]:
    """regions * racks * shards shards of weight 1, numbered from 0."""
    return [Shard(f"r{i}", f"k{j}", (i * racks + j) * shards + k) for i in range(regions) for j in range(racks) for k in range(shards)]


def grown_by_branch(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree and one more shard in a new region."""
    regions = {s.region for s in tree}
    name = next(x for i in range(len(regions) + 1) if (x := f"r{i}") not in regions)
    return [*tree, Shard(name, "k0", max(s.shard for s in tree) + 1, weight)]


def check(tree: list[Shard]) -> None:
    if not tree or len({s.shard for s in tree}) < len(tree):
        raise ValueError("a tree needs shards, each with a number of its own")
    if any(not (s.weight > 0 and math.isfinite(s.weight)) for s in tree):
        raise ValueError("weights are positive and finite")


def literal(tree: list[Shard]) -> Column:
    """The tree as one constant: regions of racks of shards, each with its path and weight. It's as large as the tree, but the plan isn't."""
    levels: dict[str, dict[str, list[Shard]]] = {}
    for s in sorted(tree, key=lambda s: (s.region, s.rack, s.shard)):
        levels.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    weigh = lambda shards: sum(s.weight for s in shards)
    nodes = []
    for region, racks in levels.items():
        inner = [{"path": f"{region}/{rack}", "weight": float(weigh(own)), "shards": [{"path": f"{region}/{rack}/{s.shard}", "weight": float(s.weight), "shard": s.shard} for s in own]} for rack, own in racks.items()]
        nodes.append({"path": region, "weight": float(sum(map(weigh, racks.values()))), "racks": inner})
    return F.from_json(F.lit(json.dumps(nodes)), TREE)


def draw(key: Column, child: Column) -> Column:
    """ln(u) / weight, u from the MD5 of key and path."""
    number = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child["path"]).cast("binary")), 1, HEX), 16, 10).cast("double")
    return F.ln((number + 0.5) / F.lit(float(16**HEX))) / child["weight"]


def best(key: Column, children: Column) -> Column:
    """The child with the largest draw; equal draws go to the later one."""
    return F.array_max(F.transform(children, lambda child, i: F.struct(draw(key, child).alias("draw"), i.alias("place"), child.alias("child"))))["child"]


def descend(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key (a string Column): the region's draw, then the rack's in it, then the shard's. Draws are made for the children of the chosen nodes only."""
    check(tree)
    return best(key, best(key, best(key, literal(tree))["racks"])["shards"])["shard"]


def place(docs: DataFrame, tree: list[Shard], *, grown: list[Shard] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, size, text_crc32, law, shard, slot and grown_shard (its shard in the tree `grown`).

    The id and the tree alone decide the shard. slot counts a shard's rows from 0 without gaps, in an order that
    hashes of id and text give; it's the row's number in its group (a prefix of the hash) and the sizes of the
    groups before, so no shard is sorted in one task, and no id's rows are. Rows that agree in all of this are
    counted before they're shuffled and follow each other. Ties of hashes go by id, checksum and size. Null ids
    are one key; null texts have size 16 and the checksum of nothing; texts may be of any length; other columns
    aren't kept; an empty table gives an empty one.
    """
    check(tree)
    groups = max(1, docs.count() // (len(tree) * GROUP_ROWS))
    digits = max(1, math.ceil(math.log(groups, 16) - 1e-9)) if groups > 1 else 1
    body = F.coalesce(frames.named(text), F.lit("")).cast("binary")
    rows = docs.select(frames.named(id_col).alias("id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    order = F.md5(F.concat_ws("/", key, "text_crc32", "size").cast("binary"))
    rows = rows.select("*", descend(key, tree).alias("shard"), (descend(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), order.alias("order"))
    rows = frames.written(rows.withColumn("group", F.substring("order", 1, digits)), "placed")
    sizes = rows.groupBy("shard", "group").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "group", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "group").orderBy("order", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    out = rows.join(sizes, ["shard", "group"]).withColumn("first", first)
    # equal rows come apart again; very many of them in spans that are dealt out
    spans = out.where(F.col("n") > SPAN).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPAN).cast("long")))).repartition("id", "at")
    spans = spans.withColumn("first", F.col("first") + F.col("at")).withColumn("n", F.least(F.col("n") - F.col("at"), F.lit(SPAN))).drop("at")
    out = out.where(F.col("n") <= SPAN).unionByName(spans) if rows.where(F.col("n") > SPAN).limit(1).count() else out
    out = out.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards (2 regions of 4 racks of 5), and where they are with one more shard."""
    tree = even_tree(2, 4, 5)
    return place(frames.table(spark, sf_dir, "documents"), tree, grown=grown_by_branch(tree))
