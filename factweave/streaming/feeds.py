"""Change feeds and signal logs, in batches and as streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from factweave.operators.feedback import reputation, scored_pairs


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``base`` after the last change per id; ``changes`` has its columns and ``action`` (upsert or delete), ``changed_at``."""
    last = changes.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("changed_at"), "action"))).where("__k = 1")
    kept = base.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.where("action = 'upsert'").select(*base.columns))


def changed_since(documents: DataFrame, cursors: DataFrame) -> DataFrame:
    """Documents that changed after their connector's cursor ``connector, cursor``; all of a connector without one."""
    rows = documents.join(cursors, "connector", "left")
    return rows.where("cursor is null or last_modified > cursor").drop("cursor")


def next_cursor(changes: DataFrame) -> DataFrame:
    return changes.groupBy("connector").agg(F.max("last_modified").alias("cursor"))


def _folder(spark: SparkSession, path: str):
    """Hadoop's view of a folder: its file system and itself."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def synced_buckets(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """In which version each bucket of a synced table was last written, as of a version (the last one)."""
    fs, folder = _folder(spark, f"{path}/versions")
    if not fs.exists(folder):
        return {}
    rows = spark.read.parquet(f"{path}/versions")
    rows = rows if version is None else rows.where(F.col("v") <= version)
    last = rows.join(F.broadcast(rows.agg(F.max("v").alias("v"))), "v").where("bucket >= 0")
    return {r["bucket"]: r["at"] for r in last.select("bucket", "at").collect()}


def read_synced(spark: SparkSession, path: str, schema: StructType, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
    """A synced table as of a version (the last one), or only some of its buckets."""
    at = synced_buckets(spark, path, version)
    wanted = at if buckets is None else [b for b in buckets if b in at]
    paths = [f"{path}/data/v={at[b]}/bucket={b}" for b in sorted(wanted)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def sync_stream(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps a table in step with a stream of changes ``id, ..., action, changed_at``; the checkpoint takes the place of the cursor.

    The table lies in ``buckets`` by a hash of ``id``. Each batch is written down, then only the buckets that it touches are read,
    changed and written again, under the batch's version; a list tells for each version where its buckets are (``read_synced``). A repeated
    batch starts from the version before it and gives the same. The list and the paths on the driver grow with the number of
    buckets alone, which is fixed when the table is begun.
    """
    columns = [f for f in changes.schema if f.name not in ("action", "changed_at")]
    schema = StructType(columns)

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).write.mode("overwrite").parquet(f"{path}/changes/v={n}")
        seen = spark.read.schema(StructType([*batch.schema, StructField("bucket", IntegerType())])).parquet(f"{path}/changes/v={n}")
        touched = [r["bucket"] for r in seen.select("bucket").distinct().collect()]
        base = read_synced(spark, path, schema, n - 1, touched)
        out = apply_changes(base, seen.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={n}")
        fs, folder = _folder(spark, f"{path}/data/v={n}")
        filled = {int(x.getPath().getName()[7:]) for x in fs.listStatus(folder) if x.getPath().getName().startswith("bucket=")}
        at = {b: v for b, v in synced_buckets(spark, path, n - 1).items() if b not in touched} | dict.fromkeys(filled, n)
        rows = [(-1, n), *at.items()]  # the first row stands for the version, also where nothing is left
        spark.createDataFrame(rows, "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={n}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reputation_stream(signals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running reputation per user; ids seen again within ``delay`` of event time count once."""
    once = signals.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    return reputation(once)


#: Kinds of signals that a reputation counts; all others only add to the total.
_COUNTED = ("corrected", "shared", "rejected", "escalated")
_STATE = "settled array<long>, times array<long>, kinds array<int>"


def pairs_stream(signals: DataFrame, keep: str = "30 days") -> DataFrame:
    """Each valid correction of a stream of signals as a pair at once, with its user's reputation at its own time.

    ``signals``: ``id, user_id, signal_type, created_at`` and, for corrections, ``original_question, original_answer, corrected_answer``. A user's
    signals before the correction count (those that have arrived; also late ones, by their own time), so the reputation of later
    days doesn't change it; without any it is 0.5. The state of a user is five counts and the signals of the last ``keep``
    before the newest; older ones are settled into the counts. Pairs are as ``corrections_to_pairs`` gives them.
    """
    span = int(pd.Timedelta(keep) / pd.Timedelta(microseconds=1))
    names = ["id", "signal_type", "created_at", "original_question", "original_answer", "corrected_answer"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, times, kinds = map(list, state.get) if state.exists else ([0] * 5, [], [])
        new = pd.concat(list(parts))
        at = new["created_at"].to_numpy().astype("datetime64[us]").astype("int64")
        kind = [_COUNTED.index(k) + 1 if k in _COUNTED else 0 for k in new["signal_type"]]
        rows = sorted([*zip(times, kinds, strict=True), *zip(at.tolist(), kind, strict=True)])
        times, kinds = [t for t, _ in rows], [k for _, k in rows]
        upto = np.cumsum(np.eye(5, dtype=np.int64)[kinds], axis=0)
        upto = np.vstack([np.zeros(5, np.int64), upto]) + np.array(settled)
        counts = upto[np.searchsorted(np.array(times), at, "left")]
        n = counts.sum(axis=1)
        score = np.clip((2 * counts[:, 1] + counts[:, 2] - counts[:, 3] - counts[:, 4]) / (n + 10), 0.0, 1.0)
        old = int(np.searchsorted(np.array(times), times[-1] - span, "left"))
        state.update((upto[old].tolist(), times[old:], kinds[old:]))
        out = new[[*names[:1], *names[2:]]].assign(score=np.where(n == 0, 0.5, score))
        yield out[(new["signal_type"] == "corrected").to_numpy()]

    out = "id string, created_at timestamp, original_question string, original_answer string, corrected_answer string, score double"
    rows = signals.select("user_id", *names).groupBy("user_id").applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.NoTimeout)
    return scored_pairs(rows)


def windowed_counts(signals: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return signals.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "signal_type").agg(F.count("*").alias("n"))
