"""SimHash near-duplicates by one-wildcard segment variants (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import documents, unused
from factweave.llm.meeting import links
from factweave.llm.spans import broadcast_if
from factweave.operators.graph import connected_components
from factweave.plans.staging import stage

SEED = 42
#: Groups up to this size are compared pair by pair in one task; larger ones are indexed again by their other bits.
GROUP = 2048
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, k: int = 3, seed: int = SEED) -> int:
    """SimHash of the ``k``-word shingles of a text, as an unsigned 64-bit number.

    A-Z is lower-cased, words are parted by ASCII white space; repeats of a shingle count. A text of fewer words is one
    shingle; without words, and for null, the fingerprint is 0. A bit is set if it is set in over half the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return h(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    counts, n = np.zeros((8, 8), np.int64), len(words) - k + 1
    for at in range(0, n, 65025):  # long texts in pieces
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[at : min(at + 65025, n)], ends[at + k - 1 : at + k - 1 + 65025], strict=False)], np.uint64)
        whole = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
        whole[: len(hashes)] = hashes
        for s in range(8):  # eight counters of 8 bits in each number, so 255 hashes at a time
            packed = ((whole >> np.uint64(s)) & _LANES).reshape(-1, 255).sum(axis=1)
            counts[s] += packed.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > n  # bits[s, j]: bit 8 j + s
    return int(sum(1 << (8 * j + s) for s in range(8) for j in range(8) if bits[s, j]))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def with_fingerprints(docs: DataFrame, k: int = 3, column: str = "fp") -> DataFrame:
    """``doc_id, text_hash, fp``; ``fp`` is a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="uint64").astype("int64")

    return docs.select("doc_id", _text_hash().alias("text_hash"), fp("text").alias(column))


def _star(fps: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among ``fps``: at most one per member. With ``side``, only links between sides."""
    m, label = len(fps), np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    if side is not None:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, True)
    while True:
        new = np.where(near, label[None, :], m).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(m))
    return fps[out], fps[label[out]]


def _group_edges(radius: int, limit: int):
    """Reads ``(key, fp)`` sorted by key; gives edges, and the rows of groups over ``limit`` as they are.

    Bit 62 of a key tells wildcard variants, whose bits 40-45 number the bit left out: of those only links that differ
    there are new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_k, left_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def groups(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, len(keys)])
            two = start[size == 2]
            if len(two):
                a, b, key = fps[two], fps[two + 1], keys[two]
                differs = ((a ^ b) >> ((key >> 40) & 63).astype(np.uint64)) & np.uint64(1)
                ok = (np.bitwise_count(a ^ b) <= radius) & (((key >> 62) & 1 == 0) | (differs == 1))
                out.append((a[ok], b[ok]))
            for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if n > limit:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + n]), pa.array(fps[at : at + n].view(np.int64)), pa.nulls(n, pa.int64())], ["key", "u", "v"])
                    continue
                key, own = int(keys[at]), fps[at : at + n]
                side = (own >> np.uint64(key >> 40 & 63)) & np.uint64(1) if key >> 62 & 1 else None
                out.append(_star(own, side, radius))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["key", "u", "v"])

        for batch in batches:
            keys = np.r_[left_k, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[left_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on
            yield from groups(keys[:cut], fps[:cut])
            left_k, left_f = keys[cut:], fps[cut:]
        yield from groups(left_k, left_f)

    return run


def _edges(keyed: DataFrame, radius: int, limit: int) -> DataFrame:
    n = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return keyed.repartition(int(n), "key").sortWithinPartitions("key").mapInArrow(_group_edges(radius, limit), "key long, u long, v long")


def _variants(fps: DataFrame, segments: int) -> DataFrame:
    """A key per segment for those equal in it, and one per segment and bit for those that differ in that bit only."""
    width = 64 // segments
    exact = [F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")).bitwiseOR(F.lit(s << 46).cast("long")) for s in range(segments)]
    wild = [
        F.shiftrightunsigned("fp", s * width)
        .bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << b)).cast("long"))
        .bitwiseOR(F.lit(1 << 62 | s << 46 | (s * width + b) << 40).cast("long"))
        for s in range(segments)
        for b in range(width)
    ]
    return fps.select(F.explode(F.array(*exact, *wild)).alias("key"), "fp")


def _refine(large: DataFrame, part: int) -> DataFrame:
    """Rows of large groups, keyed also by the parts of ``part`` bits of what their keys leave open, one bit left out.

    A key of the first kind leaves the other segment open, a refined one the other part; bits 58-59 number the open
    stretch in units of its length. Two words within the radius of 3 differ in at most one bit in one of the two parts.
    """
    key = F.col("key")
    first = part == 16
    open_at = (1 - F.shiftright(key, 46).bitwiseAND(F.lit(1).cast("long"))) * 32 if first else F.shiftright(key, 58).bitwiseAND(F.lit(3).cast("long")) * 16
    keys = [
        F.xxhash64(key, F.lit(s), F.lit(b), F.expr(f"shiftrightunsigned(fp, cast(open_at as int) + {s * part}) & {((1 << part) - 1) & ~(1 << b)}L"))
        .bitwiseAND(F.lit((1 << 58) - 1).cast("long"))
        .bitwiseOR(F.shiftleft(F.expr(f"cast(open_at div 16 + {1 - s} as bigint)"), 58) if first else F.lit(0).cast("long"))
        for s in range(2)
        for b in range(part)
    ]
    return large.withColumn("open_at", open_at).select(F.explode(F.array(*keys)).alias("key"), "fp")


def link_fingerprints(fps: DataFrame, radius: int = 3, limit: int = GROUP) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs of ``fps (fp)`` within ``radius`` differing bits.

    A fingerprint is cut into the fewest segments for which one must differ in at most one bit: ``(radius + 1) / 2``,
    made even in length. Each segment, and each segment with one bit left out, is a key; rows with equal keys are
    compared, so no pair is lost. A group gives at most one edge a member, not all its pairs. A group over ``limit``
    rows is keyed again by the halves of the segment that its key leaves open, then by their quarters, each with one bit
    left out. Every pair within the radius still meets, and 11 bits at most stay open: no group holds over 2,048.
    """
    if radius > 3:
        raise ValueError("segments are cut for a radius of 3 bits at most")
    found = stage(_edges(_variants(fps.select("fp").distinct(), 2), radius, limit), "simhash-links")
    edges = found.where("key is null").select("u", "v")
    large = found.where("key is not null").select("key", F.col("u").alias("fp"))
    for part, most in ((16, limit), (8, 1 << 62)):
        if large.isEmpty():
            break
        again = stage(_edges(_refine(large, part), radius, most), "simhash-links")
        edges = edges.unionByName(again.where("key is null").select("u", "v"))
        large = again.where("key is not null").select("key", F.col("u").alias("fp"))
    return edges.distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """Classes of documents whose SimHash fingerprints are linked, directly or through others.

    Returns one row per input row: ``doc_id``, ``text_hash``, ``fp`` (signed long), ``group_fp`` (its class) and
    ``component_id``, the smallest doc_id of the class. Copies share a fingerprint, so only distinct ones are compared.
    Null and empty texts, and those of blanks, have fingerprint 0 and are linked like any other; repeated rows get the
    same class; a null doc_id is never a class's smallest, unless the class has no other. Other columns are ignored.
    """
    prints = stage(with_fingerprints(docs, k), "simhash")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = connected_components(link_fingerprints(own, radius)).select(F.col("node").alias("fp"), F.col("component").alias("group_fp"))
    classes = stage(own.join(labels, "fp", "left").withColumn("group_fp", F.coalesce("group_fp", "fp")), "simhash-classes")
    ids = classes.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    members = classes.join(ids, "group_fp").select("fp", "group_fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "text_hash", "fp", "group_fp", "component_id")


def _keep_first(docs: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """``docs`` without all but one document of each class: the row with the smallest doc_id stays.

    ``classes`` has ``doc_id``, ``text_hash`` and the class in ``column`` of each row. Of rows that share that id the one
    with the smallest hash of its text stays, and of rows that repeat both one. All columns are returned, whatever they
    are called. A class of documents without an id keeps one row too.
    """
    found = stage(classes.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")), "near-members")
    best = found.groupBy(column).agg(F.min("rank").alias("rank")).select("rank.*")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    own, kept_id, kept_hash = unused(docs, "text_hash", "kept_id", "kept_hash")
    named = [F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)]
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash))
    out = docs.withColumn(own, _text_hash()).join(best.select(*named), same, "left_semi")
    if repeated.isEmpty():
        return out.drop(own)
    again = repeated.select(*named)
    once = out.join(again, same, "left_anti")
    twice = out.join(again, same, "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(twice).drop(own)


def drop_near_duplicates(docs: DataFrame, k: int = 5, radius: int = 3) -> DataFrame:
    """``docs`` without all but one document of each class of fingerprints; see ``near_duplicates`` and ``_keep_first``."""
    return _keep_first(docs, near_duplicates(docs, k, radius), "group_fp")


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text; words as in ``fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh3_64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words))] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)], np.uint64))


#: Segments of a document's wide fingerprint, and sampled shingles of each. Two sets of similarity s have the samples of a
#: segment in common, but for one at most, with probability p = s ** 6 + 6 * (1 - s) * s ** 5, and share a variant of one of
#: the segments with 1 - (1 - p) ** 12, which is 1 - 3e-6 at 0.8.
SEGMENTS, SAMPLES = 12, 6
_FACTORS, _PLACES = np.random.default_rng(SEED).integers(1, 1 << 63, (2, SEGMENTS * SAMPLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def segment_samples(shingles: np.ndarray) -> np.ndarray:
    """The sampled shingle hashes of all segments: the least of a set under each of as many mixings."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None]
        x = (x ^ (x >> np.uint64(29))) * _FACTORS
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return least


def segment_variants(samples: np.ndarray) -> np.ndarray:
    """The one-wildcard variants of each row's segments as signed longs: a key for each segment and sample left out.

    A variant is the SimHash of the segment's other samples: a bit is set if it is set in over half of them. So two sets
    share one if they agree in a segment but for one sample; which one and which segment is mixed into the key.
    """
    x = (samples ^ (samples >> np.uint64(31))) * _PLACES  # high bits of minima are mostly zeros
    x = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).reshape(-1, SEGMENTS, SAMPLES)
    x ^= x >> np.uint64(32)
    ones, twos, fours = np.zeros((3, *x.shape[:2]), np.uint64)  # bits of the counts of all 64 places
    for j in range(SAMPLES):
        carry = ones & x[:, :, j]
        ones, fours, twos = ones ^ x[:, :, j], fours | (twos & carry), twos ^ carry
    # of six samples four or more are set, or three and not the one left out
    fps = fours[:, :, None] | ((ones & twos & ~fours)[:, :, None] & ~x)
    return (fps.reshape(len(x), -1) ^ _PLACES).view(np.int64)


def _sets(docs: DataFrame, k: int, whole: bool) -> DataFrame:
    """``doc_id, text_hash, s1, size`` and, with ``whole``, the bytes of a row's set of shingles, else the ``keys`` of its segments.

    ``s1`` is a hash that names the set, ``size`` its number of shingles; a set without a shingle has no keys.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    last, of = ("shingles binary", pa.binary()) if whole else ("keys array<long>", pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py(), k) for t in part.column(2)]
                name = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                values = [s.tobytes() for s in sets] if whole else segment_variants(np.array([segment_samples(s) for s in sets]))
                values = pa.array([v if whole or len(s) else [] for s, v in zip(sets, values, strict=True)], of)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name), pa.array([len(s) for s in sets], pa.int64()), values], ["doc_id", "text_hash", "s1", "size", last.split(" ")[0]])

    return docs.select("doc_id", _text_hash().alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, s1 long, size long, {last}")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` of the pairs whose sets ``name, shingles`` have a Jaccard similarity of at least ``similarity``, exactly."""

    @F.pandas_udf("boolean")
    def enough(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            return both >= similarity * (len(p) + len(q) - both) - 1e-9

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    left = pairs.join(sets.select(F.col("name").alias("u"), F.col("shingles").alias("su"), F.col("size").alias("nu")), "u")
    both = left.join(sets.select(F.col("name").alias("v"), F.col("shingles").alias("sv"), F.col("size").alias("nv")), "v")
    return both.where(F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9).where(enough("su", "sv")).select("u", "v")


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of ``k``-word shingles of at least ``similarity``.

    One row per input row: ``doc_id, text_hash, class``. Rows with equal sets of shingles, by 64 bits of a hash, are one,
    also those without a word. Sets that share a one-wildcard variant of a segment of their fingerprints (see
    ``segment_variants``) meet (see ``meeting.links``), and each link is verified on the whole sets.
    """
    prints = stage(_sets(docs, k, False), "near-sets")
    named = prints.select(F.col("s1").alias("name"), "text_hash")

    def fetch(wanted: DataFrame) -> DataFrame:
        texts = named.join(broadcast_if(wanted), "name", "left_semi").groupBy("name").agg(F.first("text_hash").alias("text_hash"))
        texts = docs.withColumn("text_hash", _text_hash()).join(broadcast_if(stage(texts.select("text_hash"), "near-wanted")), "text_hash", "left_semi")
        sets = _sets(texts.select("doc_id", "text"), k, True).select(F.col("s1").alias("name"), "shingles", "size")
        return stage(sets.dropDuplicates(["name"]), "near-some")

    keyed = prints.select(F.col("s1").alias("name"), F.explode("keys").alias("key"))
    found = links(keyed, prints.select(F.col("s1").alias("name"), "size"), fetch, lambda pairs, sets: _alike(pairs, sets, similarity), similarity)
    label = broadcast_if(stage(connected_components(found).select(F.col("node").alias("s1"), F.col("component").alias("class")), "near-labels"))
    return prints.select("doc_id", "text_hash", "s1").join(label, "s1", "left").select("doc_id", "text_hash", F.coalesce("class", "s1").alias("class"))


def drop_similar(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but one document of each class; see ``similar_documents`` and ``_keep_first``."""
    return _keep_first(docs, similar_documents(docs, k, similarity), "class")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
