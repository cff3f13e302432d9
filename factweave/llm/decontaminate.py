"""Benchmark decontamination (operator 2; built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm.common import bit_slice, distance, documents, plain_words, shingle_hashes, simhash, unused
from factweave.llm.spans import broadcast_if
from factweave.plans.staging import stage

#: Fingerprints are cut into four blocks of 16 bits; within 15 bits one block differs in at most three.
BLOCKS, RADIUS = 4, 15


def _item_table(benchmark: DataFrame) -> DataFrame:
    """Distinct word sequences of the benchmark: ``key, words, n, k`` and the ids that have them."""
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return items.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(
        F.xxhash64("words").alias("key"), "words", F.size("words").alias("n"), "item_ids"
    )


def _shingles(words: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, exactly: repeats count, and a shingle weighs its length."""
    every = F.array_distinct(F.concat(a, b))

    def total(pick) -> Column:
        return F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s) * pick(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))))

    return total(F.least) / total(F.greatest)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """Passages of benchmark items in documents: ``doc_id, text_key, key, item_ids, similarity``, the best by document and item.

    Words are lower-cased and stripped of punctuation. Only windows that share a shingle with an item can be as
    similar as asked for, so windows of an item's size are laid where a shared shingle puts the item's start. Each has
    a 64-bit SimHash over its words. Items are indexed, by their number of words, under the 697 values within three
    bits of each of four blocks, so every window within 15 bits of an item of its size meets it. Candidates are
    verified by the exact weighted similarity of their ``shingle``-word shingles. Items of fewer words are compared
    whole; items without words match nothing. Null and empty texts have no windows. Rows that repeat an id and a text
    give the same rows once; items with equal words are one, with all their ids. Other columns are ignored.
    """
    if not 3 * BLOCKS <= radius <= 3 * BLOCKS + BLOCKS - 1:
        raise ValueError("the index is built for three bits a block")
    items = stage(_item_table(benchmark), "items")
    size = F.least(F.lit(shingle), F.col("n"))
    ks = sorted(r["k"] for r in items.select(size.alias("k")).distinct().collect())  # five values at most
    text_key = F.xxhash64("text")
    tokens = docs.select("doc_id", text_key.alias("text_key"), plain_words(F.col("text")).alias("words"))
    item_shingles = F.lit(None).cast("array<bigint>")
    for k in ks:
        item_shingles = F.when(size == k, shingle_hashes(F.col("words"), k)).otherwise(item_shingles)
    wanted = items.select(size.alias("k"), "n", F.posexplode(item_shingles).alias("item_pos", "hash")).distinct()
    wanted = broadcast_if(stage(wanted, "item-shingles"))
    hits = None
    for k in ks:
        found = tokens.select("doc_id", "text_key", F.size("words").alias("n_words"), F.posexplode(shingle_hashes(F.col("words"), k)).alias("pos", "hash"))
        found = found.join(wanted.where(F.col("k") == k).drop("k"), "hash")
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("item_pos"), F.col("n_words") - F.col("n")))
        found = found.select("doc_id", "text_key", start.alias("start"), "n")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:  # no item has a word
        none = [docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("key", T.LongType())]
        ids = T.StructField("item_ids", T.ArrayType(benchmark.schema["item_id"].dataType))
        return docs.sparkSession.createDataFrame([], T.StructType([*none, ids, T.StructField("similarity", T.DoubleType())]))
    places = stage(hits.distinct().groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("places")), "places")
    again = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))
    texts = docs.select("doc_id", text_key.alias("text_key"), "text").alias("d").join(places.alias("p"), again)
    windows = (
        texts.select("d.doc_id", "d.text_key", plain_words(F.col("d.text")).alias("words"), "places")
        .select("doc_id", "text_key", F.explode(F.transform("places", lambda p: F.struct(p["n"].alias("n"), F.slice(F.col("words"), p["start"] + 1, p["n"]).alias("window")))).alias("w"))
        .select("doc_id", "text_key", "w.n", "w.window")
        .distinct()
    )
    hashed = F.transform("window", lambda w: F.xxhash64(w))
    windows = stage(windows.withColumn("fp", simhash(hashed)), "windows")

    def blocks(fp: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), bit_slice(F.col(fp), 16 * b, 16).cast("int").alias("value")) for b in range(BLOCKS)])).alias("at")

    masks = F.filter(F.sequence(F.lit(0), F.lit(65535)), lambda m: F.bit_count(m) <= 3)
    indexed = (
        items.select("key", "n", simhash(F.transform("words", lambda w: F.xxhash64(w))).alias("item_fp"))
        .select("key", "n", "item_fp", blocks("item_fp"))
        .select("key", "n", "item_fp", "at.block", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("at.value")))).alias("value"))
    )
    met = (
        windows.select("doc_id", "text_key", "n", "window", "fp", blocks("fp"))
        .select("doc_id", "text_key", "n", "window", "fp", "at.block", "at.value")
        .join(indexed, ["n", "block", "value"])
        .where(distance(F.col("fp"), F.col("item_fp")) <= radius)
        .select("doc_id", "text_key", "key", "window")
        .distinct()
    )
    # few bytes here are much work, so a fixed number of partitions
    met = met.join(broadcast_if(items), "key").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text_key", "key", F.size("window"), F.xxhash64("window"))
    score = weighted_similarity(_shingles(F.col("window"), F.least(F.lit(shingle), F.col("n"), F.size("window"))), _shingles(F.col("words"), F.least(F.lit(shingle), F.col("n"))))
    scored = met.select("doc_id", "text_key", "key", "item_ids", score.alias("similarity")).where(F.col("similarity") >= similarity)
    return scored.groupBy("doc_id", "text_key", "key", "item_ids").agg(F.max("similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without those that hold a passage of the benchmark; all columns stay, whatever they are called."""
    own, bad_id, bad_key = unused(docs, "text_key", "bad_id", "bad_key")
    bad = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    bad = broadcast_if(stage(bad, "contaminated"))
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_key)), "left_anti").drop(own)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in the documents."""
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("item_ids").alias("item_id"), F.round("similarity", 6).alias("similarity")).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
