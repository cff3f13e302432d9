"""Substring dedup by content-defined chunks (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import documents
from factweave.llm.spans import broadcast_if, cut_spans
from factweave.plans.staging import release, stage


def gear_table(seed: int = 1) -> np.ndarray:
    """256 pseudo-random 32-bit numbers, one per byte, by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear rolling hash ``h = 2 h + gear[byte]`` modulo 2**32 after each byte, which forgets bytes 32 back.

    Doubled in five steps: the hash over 2 m bytes is that over the last m plus that over the m before, shifted by m.
    """
    h = GEAR[data]
    for m in (1, 2, 4, 8, 16):
        h[m:] = h[m:] + (h[:-m] << np.uint32(m))
    return h


def chunk_ends(raw: bytes, average: int = 48, least: int = 16, most: int = 512) -> np.ndarray:
    """Ends of the chunks of ``raw``.

    A chunk ends after a byte whose gear hash falls under 1/``average`` of its range, unless another such byte is within
    ``least`` before it; longer chunks are cut every ``most`` bytes from their start. All of it depends on bytes close
    by, so an insertion moves only the ends near it.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    marks = np.flatnonzero(gear_hash(np.frombuffer(raw, np.uint8)) < np.uint32((1 << 32) // average)) + 1
    marks = marks[np.diff(np.r_[-least, marks]) >= least]
    ends = np.r_[marks, n] if not len(marks) or marks[-1] != n else marks
    starts = np.r_[0, ends[:-1]]
    if (ends - starts).max(initial=0) > most:
        ends = np.unique(np.concatenate([ends, *(np.arange(a + most, b, most) for a, b in zip(starts, ends, strict=True) if b - a > most)]))
    return ends


def chunk_table(docs: DataFrame, average: int = 48, least: int = 16, most: int = 512) -> DataFrame:
    """``doc_id, text_key, at, d1, d2`` of the chunks of all texts.

    The digest has 64 bits in ``d1`` and 22 in ``d2``, whose lowest ten bits are the chunk's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, digest = [], xxhash.xxh3_128_digest
            rows = 0
            for i, text in enumerate(batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ends = chunk_ends(raw, average, least, most)
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
                made = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                lists.append((np.full(len(ends), i), starts, ends - starts, np.frombuffer(made, np.int64).reshape(-1, 2)))
                rows += len(ends)
                if rows > 200_000:
                    yield _batch(batch, lists)
                    lists, rows = [], 0
            if lists:
                yield _batch(batch, lists)

    def _batch(batch: pa.RecordBatch, lists: list) -> pa.RecordBatch:
        row, at, size, d = (np.concatenate(x) for x in zip(*lists, strict=True))
        take = pa.array(row)
        more = (d[:, 1] << 10 | size).astype(np.int32)
        arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(d[:, 0]), pa.array(more)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "at", "d1", "d2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, at int, d1 long, d2 int")


#: Equal bytes of chunks on one diagonal of two texts from which they are extended.
ANCHOR = 24
#: Slices of the kept texts that matches are extended in, one after the other, so that not all texts are on disk at once.
SLICES = 2


def _extended(matches: DataFrame, docs: DataFrame) -> list[DataFrame]:
    """``doc_id, text_key, a, b, kept_in``: matches of chunks, made longer on both sides while the two texts agree.

    A staged table for each slice of the kept texts.

    ``matches`` has ``doc_id, text_key, kept_id, kept_key`` and ``found``, an array of ``(shift, at, end)``: the bytes
    ``at`` to ``end`` are those of the kept text ``shift`` before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for i, (text, kept, found) in enumerate(zip(*(batch.column(c) for c in ("text", "kept_text", "found")), strict=True)):
                x, y = (np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8) for t in (text, kept))
                last, done = None, 0
                for shift, at, end in sorted((f["shift"], f["at"], f["end"]) for f in found.as_py()):
                    if shift == last and end <= done:
                        continue
                    m = min(at, at - shift)
                    differ = np.flatnonzero(x[at - m : at] != y[at - shift - m : at - shift])
                    first = at - m + (differ[-1] + 1 if len(differ) else 0)
                    m = min(len(x) - end, len(y) - end + shift)
                    differ = np.flatnonzero(x[end : end + m] != y[end - shift : end - shift + m])
                    last, done = shift, end + (differ[0] if len(differ) else m)
                    rows.append(i)
                    spans.append((int(first), int(done)))
            two = np.array(spans, np.int64).reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(two[:, 0]), pa.array(two[:, 1]), batch.column("kept_id").take(take)], ["doc_id", "text_key", "a", "b", "kept_in"])

    texts = docs.select(F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_key"), "text")
    if not texts.groupBy("of_id", "of_key").count().where("count > 1").isEmpty():  # else nothing need be moved for this
        texts = texts.dropDuplicates(["of_id", "of_key"])
    at_kept = F.col("of_id").eqNullSafe(F.col("kept_id")) & (F.col("of_key") == F.col("kept_key"))
    at_doc = F.col("of_id").eqNullSafe(F.col("doc_id")) & (F.col("of_key") == F.col("text_key"))
    own = lambda i, *c: F.pmod(F.xxhash64(*c), F.lit(SLICES)) == i

    def part(i: int) -> DataFrame:
        kept = texts.where(own(i, "of_id", "of_key")).withColumnRenamed("text", "kept_text")
        both = matches.where(own(i, "kept_id", "kept_key")).join(kept, at_kept).drop("of_id", "of_key").join(texts, at_doc).drop("of_id", "of_key")
        return both.mapInArrow(run, f"doc_id {kind}, text_key long, a long, b long, kept_in {kind}")

    return [stage(part(i), "chunk-extended") for i in range(SLICES)]


def _whole_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, a, b, kept_in``: whole texts of which a document with a smaller doc_id has a copy."""
    by = ["text_key", "other", "size"]
    rows = docs.where(F.octet_length("text") > 0).select("doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit("copy"), "text").alias("other"), F.octet_length("text").cast("long").alias("size")).distinct()
    first = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")).where("n > 1")
    return rows.join(first, by).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "text_key", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"), F.col("first.doc_id").alias("kept_in"))


def repeated_runs(docs: DataFrame, min_run: int = 100, average: int = 24, least: int = 8, most: int = 512) -> DataFrame:
    """Byte runs that occur before: ``doc_id, text_key, a, b, kept_in``.

    Chunks are equal if their digests are. Of each the occurrence with the smallest doc_id, then text and position, is
    kept; the others are repeats. Repeats that have ``ANCHOR`` bytes in line with those of the kept text are extended
    byte by byte. Runs of touching repeats of ``min_run`` bytes or more in all are returned; shorter ones, as of a short
    line or a set phrase, are not, unless they are a whole text. ``kept_in`` is the document that keeps the first bytes.
    """
    if most > 1023:
        raise ValueError("a chunk's size has ten bits")
    copies = _whole_copies(docs)
    # of whole copies the first speaks for all
    later = broadcast_if(stage(copies.select("doc_id", "text_key").distinct(), "chunk-copies")).select(F.col("doc_id").alias("copy_id"), F.col("text_key").alias("copy_key"))
    once = docs.join(later, F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_key")), "left_anti")
    chunks = stage(chunk_table(once, average, least, most), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "at")
    # half a digest first, so that few chunks are moved whole
    several = stage(chunks.groupBy("d1").count().where("count > 1").select("d1"), "chunk-digests")
    every, chunks = chunks, stage(chunks.join(broadcast_if(several), "d1", "left_semi"), "chunks-several")
    release(every, several)
    kept = chunks.groupBy("d1", "d2").agg(F.min(place).alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = chunks.join(kept, ["d1", "d2"]).where(place != F.col("keep"))
    again = stage(again.select("doc_id", "text_key", F.col("at").cast("long").alias("at"), (F.col("at") + F.col("d2").bitwiseAND(F.lit(1023))).cast("long").alias("end"), F.col("keep.doc_id").alias("kept_id"), F.col("keep.text_key").alias("kept_key"), (F.col("at") - F.col("keep.at")).cast("long").alias("shift")).distinct(), "chunk-repeats")
    release(chunks)  # before texts are moved
    ids = ["doc_id", "text_key", "kept_id", "kept_key"]
    lined = again.groupBy(*ids, "shift").agg(F.sum(F.col("end") - F.col("at")).alias("n"), F.collect_list(F.struct("shift", "at", "end")).alias("found")).where(F.col("n") >= ANCHOR)
    matches = stage(lined.groupBy(*ids).agg(F.flatten(F.collect_list("found")).alias("found")), "chunk-matches")
    longer = _extended(matches, docs)
    spans = again.select("doc_id", "text_key", F.col("at").alias("a"), F.col("end").alias("b"), F.col("kept_id").alias("kept_in"))
    spans = stage(reduce(DataFrame.unionByName, longer, spans), "chunk-spans")
    release(again, matches, *longer)
    order = Window.partitionBy("doc_id", "text_key").orderBy("a", F.desc("b"), "kept_in")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("a") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "text_key", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("kept_in", F.struct("a", -F.col("b"), "kept_in")).alias("kept_in"))
    return runs.where(F.col("b") - F.col("a") >= min_run).drop("run").unionByName(copies)


def dedup_substrings(docs: DataFrame, min_run: int = 100, average: int = 24, least: int = 8, most: int = 512) -> DataFrame:
    """Texts without their repeated runs: ``doc_id, n_bytes, kept_text, n_removed, n_spans, kept_sha256, kept_in``.

    One row per input row; see ``repeated_runs``. ``kept_in`` lists the documents that keep what was taken out. Null
    and empty texts have no chunks. Rows that repeat an id and a text count as one document: what is kept in one is
    kept in all. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = repeated_runs(docs, min_run, average, least, most)
    by_doc = stage(
        runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"), F.sort_array(F.collect_set("kept_in")).alias("kept_in")),
        "chunk-runs",
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    found = broadcast_if(by_doc).alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key"))
    joined = rows.join(found, same, "left").select("d.doc_id", "d.text", F.coalesce(F.octet_length("d.text"), F.lit(0)).cast("long").alias("n_bytes"), "spans", F.coalesce("kept_in", F.array().cast(f"array<{kind}>")).alias("kept_in"))
    return cut_spans(joined, f"doc_id {kind}, n_bytes long, kept_in array<{kind}>")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages."""
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_in")
