"""Cutting byte spans out of texts, shared by the substring operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Megabytes up to which a side is broadcast; a larger one is joined by a shuffle.
BROADCAST_MB = 64


def _size_of(c: Column, kind: T.DataType) -> Column | int:
    """Bytes of a value in memory, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_size_of(c[f.name], f.dataType) for f in kind.fields), 16)
    if isinstance(kind, T.ArrayType):
        each = _size_of(F.lit(None).cast(kind.elementType), kind.elementType)
        n = F.coalesce(F.size(c), F.lit(0)).cast("long")
        if isinstance(each, int):
            return n * each + 24
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda acc, x: acc + _size_of(x, kind.elementType)), F.lit(24).cast("long"))
    return 8


def size_mb(df: DataFrame) -> float:
    """Megabytes that the rows of ``df`` take in memory, about, counted over all of them."""
    row = sum((_size_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), 32)
    total = df.agg(F.sum(row if isinstance(row, Column) else F.lit(row).cast("long")).alias("n")).first()["n"]
    return (total or 0) / 1e6


def broadcast_if(df: DataFrame, mb: float = BROADCAST_MB) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``mb`` megabytes; else as it is, for a join by shuffle."""
    return F.broadcast(df) if size_mb(df) <= mb else df


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text's bytes, how many were removed, and in how many runs."""
    data, left, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
    runs = merged(spans)
    for a, b in runs:
        left.append(data[at:a])
        at = b
    left.append(data[at:])
    return b"".join(left), sum(b - a for a, b in runs), len(runs)


def cut_spans(texts: DataFrame, schema: str) -> DataFrame:
    """Rows with ``text`` and ``spans`` (arrays of ``struct(a, b)``) to ``kept_text, n_removed, n_spans, kept_sha256``.

    ``schema`` lists the other columns, which are passed on. Bytes of a character cut in half become U+FFFD in
    ``kept_text``; the digest is of the bytes.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, runs, digests = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                left, n, k = cut(text.as_py(), [(s["a"], s["b"]) for s in spans.as_py() or []])
                kept.append(left.decode("utf-8", "replace"))
                removed.append(n)
                runs.append(k)
                digests.append(hashlib.sha256(left).hexdigest())
            new = [pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *new], [*names, "kept_text", "n_removed", "n_spans", "kept_sha256"])

    return texts.select(*names, "text", "spans").mapInArrow(run, f"{schema}, kept_text string, n_removed long, n_spans long, kept_sha256 string")
