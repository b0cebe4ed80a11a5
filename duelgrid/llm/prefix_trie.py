"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of the first d turns (role, text); it is named by its smallest member conversation
and its depth.  Nodes of one name form a downward path, as a path's conversation stays the smallest one until its
last turn; a node's child on its own path comes first among its children, the others (kids, heads of other paths)
follow by bucket and name.

* Turns are dealt out by ranges of (conversation, turn, digest), so that a conversation of any length is cut into
  parts, and numbered by row numbers in the part plus the counts of the parts before.
* A prefix is known by four 32-bit sums of digests of (position, role, text): prefix sums, again by parts, so no
  conversation is folded in one task.  Two prefixes are taken as equal if their 128 bits are.
* The tour has an enter and an exit arc per node.  Arcs that follow each other on one path without a branch are one
  run (windows over at most `BLOCK` depths); a run points at the next one.  The runs are list-ranked by pointer
  doubling, each round one join and one table; arcs get their positions from their run's.
* Leaves and savings are summed over the tour by cells of `CELL` positions and the sums of the cells before; a
  node's subtree is what lies between its two arcs.
* Ids of conversations that end at a node go to its digest as sorted chunks of at most 4,096 ids, one after
  another; no list of them is ever held whole.

Rows without conv_id are left out; null role and text are empty; turns are ordered by turn, null first, and rows of
one turn by their digest; repeated rows are repeated turns.  No conversation, no node.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, pick

#: Depths of a path that one window group holds.
BLOCK = 4096
#: Positions of the tour that one window group sums.
CELL = 1 << 17
#: Paths per bucket of siblings, on average over all paths.
SIBLINGS = 1 << 16
#: Conversations of neighbouring ids whose ids are joined to one text: two to this power.
CHUNK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
LANES = ("s1", "s2", "s3", "s4")
MASK = 0xFFFFFFFF


def numbered(conversations: DataFrame, kept: Kept) -> DataFrame:
    """conv_id, part, pos (from 1), d1, d2, words, size: every turn with its place, the digest of (role, text), the
    words of the text and the turns of its conversation.  Texts are digested where they are read."""
    turns = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.lit(1), role, text).alias("d2"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), "d1", "d2", "row"]
    turns = kept(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    parts = parts.select(
        "conv_id", "part", F.sum("n").over(whole).alias("size"),
        (F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("bigint")
    return kept(turns.withColumn("place", place).join(parts, ["conv_id", "part"]).select(
        "conv_id", "part", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "d1", "d2", "words", "size"))


def with_shared_heads(turns: DataFrame, heads: int, group: int) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations rebuilt, and (conv_id, size) of all of them: the first h turns are taken from the
    first conversation of each `group` ids, the rest is a conversation's own; h is a digest of its id below `heads`.
    Lengths meet per conversation and part, and of a group's first conversation only the first turns are joined."""
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = F.col("conv_id") - F.col("conv_id") % group
    parts = turns.groupBy("conv_id", "part").agg(F.max("size").alias("size")).withColumns({"h": h, "base": base})
    firsts = turns.filter((F.col("conv_id") == base) & (F.col("pos") < heads))
    lengths = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.max("size").alias("base_size"))
    parts = parts.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    parts = parts.withColumn("total", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    own = turns.drop("size").join(parts.select("conv_id", "part", "h", "taken", "total"), ["conv_id", "part"])
    own = own.filter("pos > h").select(
        "conv_id", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "words", F.col("total").alias("size"))
    each = parts.groupBy("conv_id", "base", "taken").agg(F.max("total").alias("size"))
    lent = each.filter("taken > 0").join(firsts.drop("size", "part").withColumnRenamed("conv_id", "base"), "base")
    lent = lent.filter("pos <= taken").select("conv_id", F.lit(-1).alias("part"), "pos", "d1", "d2", "words", "size")
    return own.unionByName(lent), each.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, up_a, up_b, words, last: the prefix that ends with each turn, and the one before."""
    first, second = F.xxhash64("pos", "d1", "d2"), F.xxhash64("d2", "d1", "pos")
    mixed = turns.withColumns({"m1": first.bitwiseAND(MASK), "m2": F.shiftrightunsigned(first, 32),
                               "m3": second.bitwiseAND(MASK), "m4": F.shiftrightunsigned(second, 32)})
    here = Window.partitionBy("conv_id", "part").orderBy("pos")
    run = mixed.withColumns({s: F.sum(f"m{i}").over(here) for i, s in enumerate(LANES, 1)})
    parts = mixed.groupBy("conv_id", "part").agg(*[F.sum(f"m{i}").alias(s) for i, s in enumerate(LANES, 1)])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in LANES])
    run = run.join(parts, ["conv_id", "part"])

    def key(left: str, right: str, less: tuple) -> Column:
        lane = [(F.col(s) + F.col(f"{s}_before") - m).bitwiseAND(MASK) for s, m in zip((left, right), less)]
        return F.shiftleft(lane[0], 32).bitwiseOR(lane[1])

    none = (F.lit(0), F.lit(0))
    return run.select(
        "conv_id", F.col("pos").alias("depth"), key("s1", "s2", none).alias("a"), key("s3", "s4", none).alias("b"),
        key("s1", "s2", (F.col("m1"), F.col("m2"))).alias("up_a"), key("s3", "s4", (F.col("m3"), F.col("m4"))).alias("up_b"),
        "words", (F.col("pos") == F.col("size")).alias("last"))


def nodes_of(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """a, b, up_a, up_b, c (smallest member), depth, n_convs, words: one row per node; the root has the key (0, 0)."""
    inner = steps.groupBy("a", "b").agg(
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("conv_id").alias("c"), F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("c"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    return inner.unionByName(root.withColumns({n: zero for n in ("a", "b", "depth", "words")}).withColumns(
        {n: F.lit(None).cast("bigint") for n in ("up_a", "up_b")}))


def families(nodes: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Paths (c, top, bottom, next_kid, parent) and the nodes that have kids (c, depth, first_kid, n_kids).  Kids of
    one node are ordered by bucket and name: a bucket's kids are one window group, the buckets of a node another."""
    paths = nodes.groupBy("c").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"),
                                   F.min_by(F.struct("up_a", "up_b"), "depth").alias("up"))
    heads = paths.filter("top > 0").select("c", "up.*", F.pmod(F.xxhash64("c"), F.lit(buckets)).alias("bucket"))
    together = heads.groupBy("up_a", "up_b", "bucket").agg(F.min("c").alias("first"), F.count("*").alias("n"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("c").alias("parent"), "depth")
    together = together.join(parents, ["up_a", "up_b"])
    after = Window.partitionBy("up_a", "up_b").orderBy("bucket")
    together = together.withColumn("next_first", F.lead("first").over(after))
    kids = together.groupBy(F.col("parent").alias("c"), "depth").agg(
        F.min_by("first", "bucket").alias("first_kid"), F.sum("n").alias("n_kids"))
    own = Window.partitionBy("up_a", "up_b", "bucket").orderBy("c")
    siblings = heads.withColumn("next_own", F.lead("c").over(own)).join(
        together.select("up_a", "up_b", "bucket", "parent", "next_first"), ["up_a", "up_b", "bucket"])
    siblings = siblings.select("c", "parent", F.coalesce("next_own", "next_first").alias("next_kid"))
    return paths.drop("up").join(siblings, "c", "left"), kids


def runs_of(paths: DataFrame, kids: DataFrame, block: int) -> DataFrame:
    """c, x, low, high, nc, nx: the runs of the tour.  A run is named by its path and x, twice its first arc's depth
    (plus 1 for exits); (nc, nx) is the run after it, null for the last.  It covers the depths low to high."""
    blocks = paths.withColumn("block", F.explode(F.sequence(F.expr(f"top div {block}"), F.expr(f"bottom div {block}"))))
    blocks = blocks.withColumns({"low": F.greatest("top", F.col("block") * block), "high": F.least("bottom", (F.col("block") + 1) * block - 1)})
    below = kids.select("c", F.col("depth").alias("at"), "first_kid")
    enter = blocks.withColumn("at", F.col("high")).join(below, ["c", "at"], "left")
    ends = F.col("high") == F.col("bottom")
    enter = enter.select(
        "c", (F.col("low") * 2).alias("x"), "low", "high",
        F.when(ends, F.coalesce("first_kid", "c")).otherwise(F.col("c")).alias("nc"),
        F.when(ends & F.col("first_kid").isNull(), F.col("high") * 2 + 1).otherwise((F.col("high") + 1) * 2).alias("nx"))
    starts = blocks.withColumn("start", F.col("high"))
    branching = kids.select("c", F.col("depth").alias("start"), F.expr(f"depth div {block}").alias("block"))
    starts = starts.unionByName(branching.join(blocks, ["c", "block"]).filter("start < high").select(starts.columns))
    earlier = F.lag("start").over(Window.partitionBy("c", "block").orderBy("start"))
    leave = starts.withColumn("low", F.coalesce(earlier + 1, "low"))
    leave = leave.withColumn("at", F.col("low") - 1).join(below, ["c", "at"], "left")
    inside = F.col("low") > F.col("top")
    leave = leave.select(
        "c", (F.col("start") * 2 + 1).alias("x"), "low", F.col("start").alias("high"),
        F.when(inside, F.coalesce("first_kid", "c")).otherwise(F.coalesce("next_kid", "parent")).alias("nc"),
        F.when(inside & F.col("first_kid").isNotNull(), F.col("low") * 2).when(inside, F.col("low") * 2 - 1)
        .when(F.col("next_kid").isNotNull(), F.col("top") * 2).when(F.col("parent").isNotNull(), F.col("top") * 2 - 1).alias("nx"))
    return enter.unionByName(leave)


def ranked(runs: DataFrame, count: int, kept: Kept) -> DataFrame:
    """c, x, left: the arcs from a run's first one to the end of the tour.  A pointer spans twice as many runs after
    each round; keys are unique on both sides of the join, so no task gets more than its share."""
    arcs = (F.col("high") - F.col("low") + 1).alias("left")
    linked = kept(runs.select("c", "x", "nc", "nx", arcs))
    for _ in range(math.ceil(math.log2(max(count, 2)))):
        far = linked.select(F.col("c").alias("nc"), F.col("x").alias("nx"), F.col("nc").alias("fc"), F.col("nx").alias("fx"), F.col("left").alias("more"))
        open_ = linked.filter("nc is not null").join(far, ["nc", "nx"]).select(
            "c", "x", F.col("fc").alias("nc"), F.col("fx").alias("nx"), (F.col("left") + F.col("more")).alias("left"))
        linked = kept(linked.filter("nc is null").unionByName(open_))
        kept.drop_one(kept.count - 1)
    return linked.select("c", "x", "left")


def digest_ends(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of the ids that end at a prefix: chunks of neighbouring ids are sorted and joined where they
    meet, and a prefix's chunks run through one digest in order."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    texts = ends.groupBy("a", "b", chunk.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = "a bigint, b bigint, ends_sha256 string"

    def run(batches):
        at, digest, done = None, None, []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (a, b) == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (a, b), hashlib.sha256(ids.encode())
            yield flush()
        if at is not None:
            done.append((*at, digest.hexdigest()))
        yield flush()

    ordered = texts.repartition("a", "b").sortWithinPartitions("a", "b", "chunk")
    return ordered.select("a", "b", "ids").mapInArrow(run, schema)


def subtree_sums(places: DataFrame, cell: int) -> DataFrame:
    """c, depth, n_leaves, saved_tokens from (c, depth, enter, leave, leaf, saved): differences of prefix sums over the
    tour's positions."""
    zero = F.lit(0).cast("bigint")
    points = places.select("c", "depth", F.explode(F.array(
        F.struct(F.col("enter").alias("pos"), F.col("leaf").alias("leaf"), F.col("saved").alias("saved"), F.lit(-1).alias("side")),
        F.struct(F.col("leave").alias("pos"), zero.alias("leaf"), zero.alias("saved"), F.lit(1).alias("side")))).alias("p")).select("c", "depth", "p.*")
    points = points.withColumn("cell", F.expr(f"pos div {cell}"))
    cells = points.groupBy("cell").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", *[F.coalesce(F.sum(n).over(earlier), zero).alias(f"{n}_before") for n in ("leaf", "saved")])
    upto = Window.partitionBy("cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    summed = points.withColumns({f"{n}_here": F.coalesce(F.sum(n).over(upto), zero) for n in ("leaf", "saved")}).join(cells, "cell")
    return summed.groupBy("c", "depth").agg(*[
        F.sum(F.col("side") * (F.col(f"{n}_before") + F.col(f"{n}_here"))).alias(name)
        for n, name in (("leaf", "n_leaves"), ("saved", "saved_tokens"))])


def trie(turns: DataFrame, convs: DataFrame, kept: Kept, block: int = BLOCK, cell: int = CELL, siblings: int = SIBLINGS) -> DataFrame:
    """One row per node of the trie over numbered turns (conv_id, part, pos, d1, d2, words, size) of the conversations
    (conv_id, size): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = kept(prefixes(turns))
    nodes = kept(nodes_of(steps, convs))
    paths, kids = families(nodes, max(1, nodes.count() // siblings))
    paths, kids = kept(paths), kept(kids)
    runs = kept(runs_of(paths, kids, block))
    total = 2 * nodes.count()
    order = ranked(runs, runs.count(), kept)
    arcs = runs.join(order, ["c", "x"]).select(
        "c", (F.col("x") % 2).alias("out"), "low", "high", (F.lit(total) - F.col("left")).alias("start"))
    arcs = arcs.withColumn("depth", F.explode(F.sequence("low", "high")))
    arcs = arcs.withColumn("pos", F.col("start") + F.when(F.col("out") == 1, F.col("high") - F.col("depth")).otherwise(F.col("depth") - F.col("low")))
    arcs = arcs.groupBy("c", "depth").agg(F.min("pos").alias("enter"), F.max("pos").alias("leave"))
    heirs = nodes.select("c", (F.col("depth") - 1).alias("depth"), F.lit(1).cast("bigint").alias("heir"))
    known = nodes.join(heirs, ["c", "depth"], "left").join(kids.select("c", "depth", "n_kids"), ["c", "depth"], "left")
    known = known.withColumn("n_children", F.coalesce("heir", F.lit(0)) + F.coalesce("n_kids", F.lit(0)))
    known = kept(known.join(arcs, ["c", "depth"]).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    sums = subtree_sums(known.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), cell)
    top = paths.filter("parent is not null").select("c", F.col("top").alias("depth"), "parent")
    rootless = convs.filter("size = 0").select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "conv_id")
    ends = digest_ends(steps.filter("last").select("a", "b", "conv_id").unionByName(rootless))
    out = known.join(sums, ["c", "depth"]).join(top, ["c", "depth"], "left").join(ends, ["a", "b"], "left")
    return out.select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "c")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie of the conversations as they are."""
    kept = Kept(conversations.sparkSession, "trie")
    turns = numbered(conversations, kept)
    return trie(turns, turns.groupBy("conv_id").agg(F.max("size").alias("size")), kept, **sizes)


def shared_head_trie(conversations: DataFrame, heads: int = 4, group: int = 20, **sizes: int) -> DataFrame:
    """The trie of conversations whose first turns are those of their group's first conversation."""
    kept = Kept(conversations.sparkSession, "trie")
    turns, convs = with_shared_heads(numbered(conversations, kept), heads, group)
    return trie(kept(turns), kept(convs), kept, **sizes)
