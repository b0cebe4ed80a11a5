"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

A node that has to give n shards is split so that its left side holds n // 2 of n parts of its bytes, along
the metadata dimension whose range, measured against the range over all rows, is widest in it; a node with
one shard is a leaf of the target size (total / shards).  All nodes of a level are split together.  A median
is found by bisection with histograms: each pass sums the bytes of `BINS` bins per node and narrows the bin
that the target falls into, first on the dimension, then on doc_id and a row number among ties, so the cut
is exact to a row however many rows share a value.  What reaches the driver is at most nodes x BINS sums.
The tree is one CASE expression over the metadata; texts are read once and never moved.

Only DataFrame functions are used.  Null text has no bytes (size 8, checksum 0); null metadata sorts first.
Repeated rows are rows like others.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, pick

BINS = 2048
#: Rows, in the mean, of a bucket within which slots are numbered by a window.
SLOT_ROWS = 2_000
#: Metadata dimensions, all bigint.
DIMENSIONS = ("bytes", "chars", "origin", "tongue", "number")


@dataclass
class Node:
    shards: int
    first: int
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    weight: int = 0
    dimension: int = 0
    cut: tuple[int, ...] = ()
    left: "Node | None" = None
    right: "Node | None" = None


def ordinal(name: str) -> Column:
    """The first seven bytes of a string as a number of the same order; null is -1."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(name), 1, 14), 14, "0"), 16, 10).cast("bigint"), F.lit(-1))


def metadata(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    return pick(docs, "doc_id", "text", "lang", "source", "n_chars").select(
        "doc_id", size.alias("size"), F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).alias("text_crc32"),
        size.alias("bytes"), F.coalesce("n_chars", F.lit(-1)).cast("bigint").alias("chars"),
        ordinal("source").alias("origin"), ordinal("lang").alias("tongue"),
        F.coalesce("doc_id", F.lit(-(1 << 62))).alias("number"), F.monotonically_increasing_id().alias("row"),
    )


def goes_left(node: Node) -> Column:
    """(dimension, number, row) at or below the cut, compared as a tuple."""
    a, b, c = (F.col(x) for x in (DIMENSIONS[node.dimension], "number", "row"))
    x, y, z = node.cut
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & (c <= z))))


def walk(node: Node, of) -> Column:
    """The tree as an expression; `of` gives the value of a node that is not split."""
    return of(node) if node.left is None else F.when(goes_left(node), walk(node.left, of)).otherwise(walk(node.right, of))


def by_node(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), at)


def cuts(rows: DataFrame, root: Node, nodes: list[Node]) -> None:
    """Finds the cut of each node of a level."""
    place = {id(n): i for i, n in enumerate(nodes)}
    at = walk(root, lambda n: F.lit(place.get(id(n), -1)))
    ranked = rows.withColumn("node", at).filter("node >= 0")
    own = F.lit(None).cast("bigint")
    for i, n in enumerate(nodes):
        own = F.when(F.col("node") == i, F.col(DIMENSIONS[n.dimension])).otherwise(own)
    ranked = ranked.select("node", own.alias("k0"), F.col("number").alias("k1"), F.col("row").alias("k2"), "size")
    goal = [n.weight * (n.shards // 2) / n.shards for n in nodes]
    below = [0] * len(nodes)  # bytes of the rows under the range that is still open
    fixed: list[list[int]] = [[] for _ in nodes]  # the cut's leading values
    met: list = [None] * len(nodes)  # what the last pass saw in the open range
    for j in range(3):
        key, inside = F.col(f"k{j}"), ranked
        for i in range(j):
            inside = inside.filter(F.col(f"k{i}") == by_node([f[i] for f in fixed], F.col("node")))
        low = [r["next_low"] if j else n.low[n.dimension] for r, n in zip(met, nodes)]
        high = [r["next_high"] if j else n.high[n.dimension] for r, n in zip(met, nodes)]
        following = F.col(f"k{min(j + 1, 2)}")
        while True:
            width = [max(1, -(-(b - a + 1) // BINS)) for a, b in zip(low, high)]
            a, b, w = (by_node(x, F.col("node")) for x in (low, high, width))
            sums = (inside.filter(key.between(a, b))
                    .select("node", "k0", "k1", "k2", "size", ((key - a) - F.pmod(key - a, w)).alias("offset"))
                    .groupBy("node", "offset").agg(
                        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(following).alias("next_low"),
                        F.max(following).alias("next_high"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(3)]).collect())
            for i in range(len(nodes)):
                for r in sorted((r for r in sums if r["node"] == i), key=lambda r: r["offset"]):
                    met[i] = r
                    if below[i] + r["bytes"] >= goal[i]:
                        break
                    below[i] += r["bytes"]
                else:
                    below[i] -= met[i]["bytes"]  # rounding left the goal above the last bin
                low[i], high[i] = low[i] + met[i]["offset"], min(high[i], low[i] + met[i]["offset"] + width[i] - 1)
            if all(r["rows"] == 1 for r in met) or low == high:
                break
        if all(r["rows"] == 1 for r in met):
            break
        for i, value in enumerate(low):
            fixed[i].append(value)
    # the row at the cut goes to the side that it brings nearer to the goal
    for n, r, own, want in zip(nodes, met, below, goal):
        n.cut = (r["k0"], r["k1"], r["k2"] if own + r["bytes"] - want <= want - own else r["k2"] - 1)


def tree(rows: DataFrame, shards: int) -> Node:
    root = Node(shards, 0)
    level, whole = [root], None
    while level:
        place = {id(n): i for i, n in enumerate(level)}
        stats = rows.groupBy(walk(root, lambda n: F.lit(place.get(id(n), -1))).alias("node")).agg(
            F.sum("size").alias("weight"), F.count(F.lit(1)).alias("rows"),
            *[f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))])
        for r in stats.collect():
            if r["node"] >= 0:
                n = level[r["node"]]
                n.weight, n.low, n.high = r["weight"], [r[f"low_{d}"] for d in DIMENSIONS], [r[f"high_{d}"] for d in DIMENSIONS]
        level = [n for n in level if n.low and n.shards > 1]
        if not level:
            break
        whole = whole or (root.low, root.high)
        for n in level:
            spread = [(b - a) / (wb - wa) if wb > wa else 0.0 for a, b, wa, wb in zip(n.low, n.high, *whole)]
            n.dimension = max(range(len(DIMENSIONS)), key=lambda k: (spread[k], -k))
        cuts(rows, root, level)
        for n in level:
            half = n.shards // 2
            n.left, n.right = Node(half, n.first), Node(n.shards - half, n.first + half)
        level = [m for n in level for m in (n.left, n.right) if m.shards > 1]
    return root


def kd_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs."""
    kept = Kept(docs.sparkSession, "sharding")
    rows = kept(metadata(docs))
    root = tree(rows, shards)
    placed = rows.withColumn("shard", walk(root, lambda n: F.lit(n.first)).cast("int"))
    buckets = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("number", "row"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    numbered = placed.withColumn("place", F.row_number().over(
        Window.partitionBy("shard", "bucket").orderBy("number", "row")) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") + F.col("offset")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
