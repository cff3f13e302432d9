"""The prefix trie of conversations (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.spans import broadcast_if
from factweave.plans.staging import release, stage

#: Counters of a sketch's row per prefix, and at most: 2 ** 27 counters are 16 MB once they are bits.
COUNTERS, MOST_COUNTERS = 4, 1 << 27
#: Sketch rows; a prefix's counter in each is part of its digest.
SKETCH = ("p1", "p2")
NODE = ["p1", "p2"]


def _running(rows: DataFrame, order: str, **values: Column) -> DataFrame:
    """``rows (conv_id, part, ...)`` with sums (``xor_`` names: exclusive ors) of ``values`` up to each row of a conversation.

    Inside each part, and over the totals of the parts before: a long conversation is never one task's.
    """
    fold = {name: F.bit_xor if name.startswith("xor_") else F.sum for name in values}
    totals = rows.groupBy("conv_id", "part").agg(*[fold[n](v).alias(f"{n}_all") for n, v in values.items()])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("conv_id", "part", *[F.coalesce(fold[n](f"{n}_all").over(earlier), F.lit(0).cast("long")).alias(f"{n}_before") for n in values])
    inside = Window.partitionBy("conv_id", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({n: fold[n](v).over(inside) for n, v in values.items()}).join(base, ["conv_id", "part"])
    both = {n: F.col(n).bitwiseXOR(F.col(f"{n}_before")) if n.startswith("xor_") else F.col(n) + F.col(f"{n}_before") for n in values}
    return out.withColumns(both).drop(*[f"{n}_before" for n in values])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, pos, item, n_bytes`` of each turn, from a table ``conv_id, turn, role, text``.

    Turns go by ``turn``, null first, ties by a digest of role and text; repeats are turns of their own. ``pos`` starts at 1.
    ``item`` is that digest; a null role or text is empty. Rows are dealt out by ranges in this order, ``part`` being the range, so a long
    conversation is spread. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", item.alias("item"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv_id", F.asc_nulls_first("turn"), "item", "copy"]
    dealt = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id().cast("long")), "trie-turns")
    place = dealt.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:])))
    turns = stage(_running(place, "at", pos=F.lit(1).cast("long")).select("conv_id", "part", "pos", "item", "n_bytes"), "trie-turns")
    release(dealt)
    return turns


def borrowed_heads(turns: DataFrame, most: int = 8, group: int = 5) -> DataFrame:
    """Conversations rebuilt so that those of a group begin alike: ``turns``, also of conversations that are left without any.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % group``, ``h`` a checksum of ``c`` modulo ``most + 1``; its own
    turns after its first ``h`` follow. One row with ``pos`` 0 stands for each conversation.
    """
    head = F.array_sort(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", "item", "n_bytes"))))
    heads = stage(turns.groupBy("conv_id").agg(head.alias("head")), "trie-heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = heads.select(F.col("conv_id").alias("base"), "head")
    convs = heads.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).join(base, "base", "left")
    convs = stage(convs.select("conv_id", "h", F.filter(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), lambda x: x["pos"] <= F.col("h")).alias("head")), "trie-heads")
    first = convs.select("conv_id", F.lit(-1).cast("long").alias("part"), F.explode("head").alias("x")).select("conv_id", "part", "x.*")
    sizes = convs.select("conv_id", "h", F.size("head").alias("m"))
    later = turns.join(broadcast_if(sizes), "conv_id").where("pos > h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "item", "n_bytes")
    root = convs.select("conv_id", F.lit(-2).cast("long").alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("n_bytes"))
    out = stage(first.unionByName(later).unionByName(root), "trie-rebuilt")
    release(heads, convs)
    return out


def with_roots(turns: DataFrame) -> DataFrame:
    """``turns`` with one row of ``pos`` 0 for each conversation."""
    root = turns.select("conv_id").distinct().select("conv_id", F.lit(-2).cast("long").alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("n_bytes"))
    return turns.unionByName(root)


def prefix_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, part, depth, p1, p2, q1, q2, n_bytes, last``: digests of each conversation's prefixes and of those one turn shorter.

    A prefix's digest is the exclusive or of 128-bit hashes of its turns, each with its position, so it needs no more than
    the totals of what stands before. ``last``: the conversation ends here.
    """
    hashed = {"xor_1": F.xxhash64("item", "pos"), "xor_2": F.xxhash64("pos", "item")}
    hashed = {k: F.when(F.col("pos") > 0, v).otherwise(F.lit(0).cast("long")) for k, v in hashed.items()}
    ends = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    rows = _running(turns.withColumns({f"f_{k}": v for k, v in hashed.items()}), "pos", xor_1=F.col("f_xor_1"), xor_2=F.col("f_xor_2")).join(broadcast_if(ends), "conv_id")
    return rows.select("conv_id", "part", F.col("pos").alias("depth"), F.col("xor_1").alias("p1"), F.col("xor_2").alias("p2"), F.col("xor_1").bitwiseXOR(F.col("f_xor_1")).alias("q1"), F.col("xor_2").bitwiseXOR(F.col("f_xor_2")).alias("q2"), "n_bytes", (F.col("pos") == F.col("n")).alias("last"))


def _cell(row: int, digest: str, width: int) -> Column:
    return F.col(digest).bitwiseAND(F.lit(width - 1)) + F.lit(row * width + 1)


def shared_counters(prefixes: DataFrame, width: int) -> DataFrame:
    """The count-min sketch of all prefixes, each counter cut down to one bit: counted twice or more.

    ``bucket, bits``: bitmaps of 32,768 counters, at most ``2 * width`` bits in all. Counters are sums, made before the shuffle.
    """
    cells = prefixes.select(F.explode(F.array(*[_cell(i, c, width) for i, c in enumerate(SKETCH)])).alias("cell"))
    over = cells.groupBy("cell").count().where("count > 1")
    return over.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def _screen(rows: DataFrame, sketch: DataFrame, width: int, digests: tuple[str, str], name: str) -> DataFrame:
    """``rows`` with ``name``: the estimate of a prefix is over one, in every row of the sketch."""
    flag = F.lit(True)
    for i, c in enumerate(digests):
        bits = sketch.select(F.col("bucket").alias(f"bucket{i}"), F.col("bits").alias(f"bits{i}"))
        at = F.bitmap_bit_position(_cell(i, c, width)).cast("int")
        rows = rows.withColumn(f"bucket{i}", F.bitmap_bucket_number(_cell(i, c, width))).join(F.broadcast(bits), f"bucket{i}", "left")
        byte = F.conv(F.hex(F.substring(f"bits{i}", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
        flag = flag & F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return rows.withColumn(name, flag).drop("bucket0", "bits0", "bucket1", "bits1")


def _end_digests(ends: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256`` from the conversations ``conv_id`` that end at a node.

    Ids are written out in blocks of 4,096; a node's blocks then pass one hash function in order, which keeps no more than one
    block. (A hash of a list can't be made in parts, so a node's list does pass one task, about 7 bytes an id.)
    """
    block = F.shiftright("conv_id", 12)
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")))
    blocks = ends.groupBy(*NODE, block.alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for p1, p2, text in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if (p1, p2) != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield table(done)
        if key:
            yield table([(*key, state.hexdigest())])

    def table(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["p1", "p2", "ends_sha256"])

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select("p1", "p2", "ids").mapInArrow(run, "p1 long, p2 long, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """The nodes of the prefix trie of conversations: one row per distinct sequence of first turns.

    ``turns``: as ``with_roots`` or ``borrowed_heads`` give them. Columns: ``conv_id`` (a node's smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes that the subtree's members share and need only once) and
    ``ends_sha256`` (of the members that end here).

    A count-min sketch of all prefix digests is broadcast as bits (of bounded size). Where it estimates one, the prefix
    is its conversation's alone: its row is written where it stands. Only the others shuffle, to be grouped exactly; so a
    wrong estimate costs work and changes nothing. Sums over subtrees are sums over members: each leaf, and each node's
    saving, is counted at the node's smallest member. No conversations give no rows, not even a root.
    """
    rows = stage(prefix_digests(turns), "trie-prefixes")
    width = 1 << 15
    while width < min(COUNTERS * rows.count(), most_counters):
        width *= 2
    sketch = stage(shared_counters(rows.where("depth > 0"), width), "trie-sketch")
    flagged = _screen(_screen(rows, sketch, width, SKETCH, "own"), sketch, width, ("q1", "q2"), "up")
    flagged = stage(flagged.withColumns({"own": F.col("own") | (F.col("depth") == 0), "up": F.col("up") | (F.col("depth") == 1)}), "trie-rows")
    maybe, alone = flagged.where("own"), flagged.where("not own")
    nodes = maybe.groupBy(*NODE).agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("n_bytes").alias("n_bytes"))
    nodes = stage(nodes, "trie-nodes")
    edge = alone.where("up")
    kids = nodes.where("depth > 0").select("q1", "q2").unionByName(edge.select("q1", "q2")).groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    kids = stage(kids, "trie-kids")
    # leaves and savings, each at its smallest member
    leaves = nodes.join(kids, NODE, "left_anti").select("conv_id").unionByName(alone.where("last").select("conv_id")).withColumn("leaf", F.lit(1).cast("long"))
    worth = nodes.where("n_convs > 1 and n_bytes > 0").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("w"))
    worth = stage(worth, "trie-worth")
    savers = worth.groupBy("conv_id").agg(F.sum("w").alias("all_w"))
    of_savers = maybe.join(broadcast_if(savers), "conv_id").join(worth, ["conv_id", "depth"], "left")
    later = _running(of_savers, "depth", upto=F.coalesce("w", F.lit(0).cast("long"))).select(*NODE, (F.col("all_w") - F.col("upto") + F.coalesce("w", F.lit(0).cast("long"))).alias("saved"), F.lit(0).cast("long").alias("leaf"))
    ended = maybe.join(broadcast_if(leaves), "conv_id").select(*NODE, F.lit(0).cast("long").alias("saved"), "leaf")
    sums = later.unionByName(ended).groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = _end_digests(maybe.where("last").select(*NODE, "conv_id"))
    parents = broadcast_if(nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent")))
    none, zero = F.lit(hashlib.sha256(b"").hexdigest()), F.lit(0).cast("long")
    exact = nodes.join(kids, NODE, "left").join(sums, NODE, "left").join(ends, NODE, "left").join(parents, ["q1", "q2"], "left")
    exact = exact.withColumns({
        "parent_conv_id": F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")),
        "n_children": F.coalesce("n_children", zero),
        "n_leaves": F.coalesce("n_leaves", zero),
        "saved_tokens": F.coalesce("saved_tokens", zero),
        "ends_sha256": F.coalesce("ends_sha256", none),
    })
    single = {
        "n_convs": F.lit(1).cast("long"),
        "n_children": F.when(F.col("last"), 0).otherwise(1).cast("long"),
        "n_leaves": F.lit(1).cast("long"),
        "saved_tokens": zero,
        "ends_sha256": F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none),
    }
    first = edge.join(parents, ["q1", "q2"], "left").withColumns({**single, "parent_conv_id": F.coalesce("parent", "conv_id")})
    tails = alone.where("not up").withColumns({**single, "parent_conv_id": F.col("conv_id")})
    out = stage(exact.select(*RESULT).unionByName(first.select(*RESULT)).unionByName(tails.select(*RESULT)), "trie")
    release(rows, sketch, flagged, nodes, kids, worth)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that groups of five share their beginnings."""
    turns = numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(borrowed_heads(turns))
