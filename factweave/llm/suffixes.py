"""Exact substring dedup over sorted, sampled suffixes (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.chunks import GEAR
from factweave.llm.common import documents
from factweave.llm.spans import broadcast_if, cut_spans
from factweave.plans.staging import stage

LENGTH = 200
#: A suffix is sampled for the least hash of ``GRAM`` bytes in each window of ``WINDOW`` starts of strings.
GRAM = 40
WINDOW = LENGTH - GRAM + 1


def sampled_suffixes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that stand for all ``LENGTH``-byte strings of ``raw``: their starts, and the first and last string of each.

    A string's suffix starts where, within it, the hash of ``GRAM`` bytes is least (the leftmost of equals). That
    depends on the string only, so equal strings have their suffixes at the same offset (winnowing, Schleimer et al.,
    2003). About one start in 80 is sampled.
    """
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    h = GEAR[np.frombuffer(raw, np.uint8)]
    factor = 0x9E3779B1
    eight = None
    for m in (1, 2, 4, 8, 16):  # a polynomial in ``factor``: over 2 m bytes from those over m
        eight = h if m == 8 else eight
        h = h[:-m] * np.uint32(pow(factor, m, 1 << 32)) + h[m:]
    h = h[:-8] * np.uint32(pow(factor, 8, 1 << 32)) + eight[32:]  # 32 bytes and 8
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    least = ((h ^ (h >> np.uint32(13))).astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= WINDOW:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    if m < WINDOW:
        rest = WINDOW - m
        least = np.minimum(least[:-rest], least[rest:])
    at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], n] - 1


def _ids() -> list[Column]:
    """Two hashes that name a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def _suffix_keys(texts: DataFrame) -> DataFrame:
    """``key``: the hash of the leading bytes of each sampled suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys = []
            for text in batch.column(0):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                keys += [h(raw[a : a + GRAM]) for a in sampled_suffixes(raw)[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], ["key"])

    return texts.select("text").mapInArrow(run, "key long")


def _suffix_table(texts: DataFrame) -> DataFrame:
    """``t1, t2, place, key, h1, h2``: a suffix with the digest of its hull, all bytes that its strings cover.

    ``place`` packs the suffix's start and the offsets of its first and last string back from it, of 8 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            rows, keys, places, hulls = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                at, first, last = sampled_suffixes(raw)
                rows.append(np.full(len(at), i))
                places.append(at << 16 | (at - first) << 8 | (at - last))
                for a, f, g in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                    keys.append(h(raw[a : a + GRAM]))
                    hulls.append(digest(raw[f : g + LENGTH], (a - f) << 8 | (a - g)))
            if not keys:
                continue
            take = pa.array(np.concatenate(rows))
            two = np.frombuffer(b"".join(hulls), np.int64).reshape(-1, 2)
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(places)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(two[:, 0]), pa.array(two[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "place", "key", "h1", "h2"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, place long, key long, h1 long, h2 long")


ROW = "t1 long, t2 long, place long, key long, low int, high int, ctx binary"


def _contexts(texts: DataFrame) -> DataFrame:
    """Rows of ``ROW``: suffixes with the bytes of their hulls; the string at offset ``o`` starts at byte ``high - o``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t1, t2, text, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for x in found.as_py():
                    at, high, low = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                    out.append((t1.as_py(), t2.as_py(), x["place"], x["key"], low, high, raw[at - high : at - low + LENGTH]))
                if len(out) > 20_000:
                    yield _record(out)
                    out = []
            if out:
                yield _record(out)

    return texts.select("t1", "t2", "text", "found").mapInArrow(run, ROW)


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], ["t1", "t2", "place", "key", "low", "high", "ctx"])


def _shared(parts: list[bytes], width: int) -> np.ndarray:
    """How many leading bytes each part shares with the next."""
    n = len(parts)
    table = np.zeros((n, width + 1), np.uint8)
    sizes = np.array([len(x) for x in parts])
    flat = np.frombuffer(b"".join(parts), np.uint8)
    table[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    differ = table[1:] != table[:-1]
    differ[:, width] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))


def _neighbours(right: bool, edges: bool):
    """Compares each row of ``ROW``, sorted by what follows (``right``) or precedes it, with the next of its key.

    Gives ``t1, t2, place, lo, hi, bound`` for both rows of a pair: the offsets at which their strings are equal, and the
    bytes shared on the sorted side. With ``edges`` also the first and last row of the partition, with its number; a
    partition of one row gives it once, so that it doesn't meet itself.
    """
    schema = ["t1", "t2", "place", "lo", "hi", "bound", "part", "key", "low", "high", "ctx"]

    def pairs(rows: list[tuple]) -> pa.RecordBatch | None:
        same = np.array([x[3] for x in rows[1:]]) == np.array([x[3] for x in rows[:-1]])
        if not same.any():
            return None
        after = _shared([x[6][x[5] :] for x in rows], LENGTH)
        before = _shared([x[6][: x[5]][::-1] for x in rows], 256)
        out = []
        for side in (slice(0, -1), slice(1, None)):
            own = rows[side]
            lo = np.maximum(np.array([x[4] for x in own]), LENGTH - after)[same]
            hi = np.minimum(np.array([x[5] for x in own]), before)[same]
            out.append([*(np.array([x[i] for x in own])[same] for i in range(3)), lo, hi, (after if right else before)[same]])
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)]
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], schema)

    def edge(row: tuple, last: int) -> pa.RecordBatch:
        part = 2 * TaskContext.get().partitionId() + last
        values = [*row[:3], 0, 0, 0, part, *row[3:]]
        kinds = [pa.int64()] * 8 + [pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several = None, False
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                piece = batch.slice(at, 20_000)
                rows = list(zip(*(piece.column(i).to_pylist() for i in range(7)), strict=True))
                if held is None and edges:
                    yield edge(rows[0], 0)
                rows = rows if held is None else [held, *rows]
                if len(rows) > 1 and (got := pairs(rows)) is not None:
                    yield got
                several |= len(rows) > 1
                held = rows[-1]
        if several and edges:
            yield edge(held, 1)

    return run


PAIR = "t1 long, t2 long, place long, lo long, hi long, bound long, part long, key long, low int, high int, ctx binary"


def _sorted_pairs(rows: DataFrame, right: bool) -> DataFrame:
    """Neighbours in one order of all suffixes: ``t1, t2, place, lo, hi, bound``.

    Sampled splitters part the suffixes into ranges by their leading bytes (ties by place, so that equal ones can be
    parted), each range is sorted by one task, and ends of ranges are compared across their boundaries.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = F.substring("ctx", F.col("high") + 1, F.lit(LENGTH)) if right else F.reverse(F.hex(F.substring("ctx", F.lit(1), F.col("high"))))
    order = ["key", "side", "t1", "place"]
    dealt = rows.withColumn("side", side).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("side")
    found = stage(dealt.select(*[x.split()[0] for x in ROW.split(", ")]).mapInArrow(_neighbours(right, True), PAIR), "suffix-pairs")
    # at most two rows a range
    ends = found.where("part is not null").repartition(1).sortWithinPartitions("part").select(*[x.split()[0] for x in ROW.split(", ")])
    across = ends.mapInArrow(_neighbours(right, False), PAIR)
    return found.where("part is null").unionByName(across).select("t1", "t2", "place", "lo", "hi", "bound", F.lit(right).alias("right"))


def _by_halves(rows: DataFrame) -> DataFrame:
    """Spans ``t1, t2, a, b`` of the repeated strings of ``ROW`` rows, by halving blocks of offsets.

    What all strings of a block have in common is its core, what the suffix's own cover together its hull. If the core
    occurs once, no string of the block is repeated; if the hull occurs again, all are, and one suffix goes on for the
    rest to be compared with; else the block is halved.
    """
    size, spans = 128, None
    low, high, block, at = F.col("low"), F.col("high"), F.col("block"), F.shiftright("place", 16)
    columns = [x.split()[0] for x in ROW.split(", ")] + ["block"]
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))).withColumn("block", block * size)
    while True:
        near, far = F.greatest(low, block), F.least(high, block + (size - 1))
        core = F.substring("ctx", high - block + 1, F.lit(LENGTH - (size - 1)))
        hull = F.substring("ctx", high - far + 1, far - near + LENGTH)
        hashed = stage(
            rows.select(*columns, F.xxhash64("key", "block", core).alias("core"), F.xxhash64("key", near, far, hull).alias("h1"), F.xxhash64(hull, F.lit(2), "key").alias("h2")), "suffix-blocks"
        )
        by = ["core", "h1", "h2"]
        hulls = hashed.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.xxhash64("t1", "t2", "place")).alias("one"))
        cores = hulls.groupBy("core").agg(F.sum("n").alias("m")).where("m > 1").select("core")
        left = stage(hashed.join(hulls.join(cores, "core"), by).select(*columns, "n", "one"), "suffix-blocks")
        done = left.where("n > 1").select("t1", "t2", (at - far).alias("a"), (at - near + LENGTH).alias("b"))
        spans = done if spans is None else spans.unionByName(done)
        if size == 1:
            return spans
        size //= 2
        rows = left.where((F.col("n") == 1) | (F.xxhash64("t1", "t2", "place") == F.col("one"))).select(*columns)
        rows = rows.withColumn("block", F.explode(F.array(block, block + size)))
        rows = rows.where((block <= high) & (block + (size - 1) >= low))


def repeated_strings(docs: DataFrame) -> DataFrame:
    """Spans ``t1, t2, a, b`` of all ``LENGTH``-byte strings of texts that occur in another text or again in the same.

    Suffixes are sampled (see ``sampled_suffixes``). Those whose leading bytes are unique hold no repeat and go; those
    whose whole hulls are equal are repeats, and one goes on. These are sorted by what follows and by what precedes the
    sampled start (see ``_sorted_pairs``). Neighbours tell strings that are repeated, and no other suffix can share more
    on that side, so they also bound what can be. Where the two don't meet, as in groups whose best neighbours differ by
    side, all suffixes of that key are compared exactly by halves. Equality of hulls is by 128-bit hashes.
    """
    copies = docs.select("doc_id", *_ids()).groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n > 1").select("t1", "t2", F.lit(True).alias("copied"), "rep")
    copies = stage(copies, "suffix-copies")
    texts = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", "text", *_ids()).join(broadcast_if(copies), ["t1", "t2"], "left")
    texts = texts.where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))).select("t1", "t2", "text")
    shared = stage(_suffix_keys(texts).groupBy("key").count().where("count > 1").select("key"), "suffix-keys")
    found = stage(_suffix_table(texts).join(broadcast_if(shared), "key"), "suffixes")
    hulls = stage(found.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("t1", "t2", "place")]), "suffix-hulls")
    equal = broadcast_if(hulls.where("n > 1").select("key", "h1", "h2"))
    at, high, low = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("long")), F.col("place").bitwiseAND(F.lit(255).cast("long"))
    same = found.join(equal, ["key", "h1", "h2"]).select("t1", "t2", (at - high).alias("a"), (at - low + LENGTH).alias("b"))
    several = hulls.groupBy("key").count().where("count > 1").select("key")
    places = stage(hulls.join(several, "key").groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "place")).alias("found")), "suffix-places")
    rows = stage(_contexts(texts.join(places, ["t1", "t2"])), "suffix-contexts")
    pairs = _sorted_pairs(rows, True).unionByName(_sorted_pairs(rows, False))
    told = F.when(F.col("lo") <= F.col("hi"), F.struct("lo", "hi"))
    most = lambda right: F.coalesce(F.max(F.when(F.col("right") == right, F.col("bound"))), F.lit(0))
    known = stage(pairs.groupBy("t1", "t2", "place").agg(F.sort_array(F.collect_set(told)).alias("told"), most(True).alias("after"), most(False).alias("before")), "suffix-known")
    lo, hi = F.greatest(low, LENGTH - F.col("after")), F.least(high, F.col("before"))
    # how far, from the lowest offset that can be, what is told reaches without a gap
    reach = F.aggregate("told", lo - 1, lambda acc, x: F.when(x["lo"] <= acc + 1, F.greatest(acc, x["hi"])).otherwise(acc))
    spans = same.unionByName(known.select("t1", "t2", at.alias("at"), F.explode("told").alias("x")).select("t1", "t2", (F.col("at") - F.col("x.hi")).alias("a"), (F.col("at") - F.col("x.lo") + LENGTH).alias("b")))
    open_ = known.where((lo <= hi) & (reach < hi)).select("t1", "t2", "place")
    keys = stage(rows.join(broadcast_if(open_), ["t1", "t2", "place"], "left_semi").select("key").distinct(), "suffix-open")
    if keys.isEmpty():
        return spans
    return spans.unionByName(_by_halves(rows.join(broadcast_if(keys), "key", "left_semi")))


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """Texts without each byte that a repeated ``LENGTH``-byte string covers: ``doc_id, n_bytes, kept_text, n_removed, n_spans, kept_sha256``.

    Strings lie within one text, count wherever else they start, also in the same text, and are judged on the input.
    A text of which there are copies goes whole, if it has ``LENGTH`` bytes; for the rest see ``repeated_strings``. One
    row per input row; rows that repeat are copies of each other. Null and empty texts have no bytes, and a null
    doc_id is kept; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    copies = docs.select(*_ids(), size.alias("n")).where(F.col("n") >= LENGTH).groupBy("t1", "t2", "n").count().where("count > 1")
    spans = repeated_strings(docs).unionByName(copies.select("t1", "t2", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    by_text = stage(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")
    joined = docs.select("doc_id", *_ids(), "text").join(by_text, ["t1", "t2"], "left")
    return cut_spans(joined.select("doc_id", "text", size.alias("n_bytes"), "spans"), f"doc_id {kind}, n_bytes long")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes that occur elsewhere in strings of 200."""
    return dedup_suffixes(documents(spark, sf_dir)).drop("kept_text")
