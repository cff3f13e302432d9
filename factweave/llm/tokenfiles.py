"""Token ids in Parquet files (operator 13)."""

from __future__ import annotations

import functools
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import documents
from factweave.llm.spans import broadcast_if
from factweave.plans.staging import shared_dir

#: Words whose ids a worker keeps; beyond, it starts anew.
KEPT_WORDS = 600_000
#: Letters, then marks that no rule of a vocabulary joins with them.
LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([.,;:!?)\]]+)")
#: Bits of ``seq`` that number the rows of a file.
ROW_BITS = 33


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the file of a public tokenizer is on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordIds:
    """Ids of words as bytes (32-bit integers), made by the tokenizer once per word.

    The vocabulary drops white space, never joins characters across it, and parts letters from marks, so a text's ids are
    those of its words, and a word's those of its letters and of the marks behind them. The first ``KEPT_WORDS`` words stay
    known; later ones are made again in each lot that has them.
    """

    def __init__(self, name: str, path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path or vocabulary(name)), {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<i4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Of words of letters alone: these are encoded as one text, which tells where a word's ids end."""
        if not words:
            return []
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        word = np.array(got.word_ids)
        at = np.flatnonzero(np.diff(word, prepend=-1))
        if len(at) != len(words):  # a letter that the tokenizer doesn't take for one
            return self._each(words)
        ids = np.array(got.ids, "<i4").tobytes()
        cuts = [*(at * 4).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't known, and from now on are if there is room."""
        parts = [(t, "") if t.isalpha() else m.groups() if (m := LETTERS_AND_MARKS.fullmatch(t)) else (t, "") for t in words]
        # letters A-Z alone are made small here, as the vocabulary does with all, so that more words are known
        parts = [(a.lower() if a.isascii() and a.isalpha() else a, b) for a, b in parts]
        ids = {a: self.known.get(a) for a, _ in parts if a.isalpha()} | {"": b""}
        heads = [a for a, known in ids.items() if known is None]
        ids |= zip(heads, self._letters(heads), strict=True)
        rest = list({x for p in parts for x in p if x not in ids})
        ids |= zip(rest, self._each(rest), strict=True)
        out = [ids[a] + ids[b] for a, b in parts]
        room = max(0, KEPT_WORDS - len(self.known)) // 2
        self.known |= itertools.islice(zip(words, out, strict=True), room)
        self.known |= itertools.islice(((a, ids[a]) for a in heads), room)
        return out

    def of(self, texts: pa.Array, end: int) -> pa.ListArray:
        """The ids of each text, with ``end`` behind them. White space parts words, blanks at a text's ends leave empty ones."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        here = coded.dictionary.to_pylist()
        ids = [*map(self.known.get, here)]
        missing = [k for k, known in enumerate(ids) if known is None]
        for k, new in zip(missing, self._new([here[k] for k in missing]), strict=True):
            ids[k] = new
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        word = np.asarray(coded.indices)
        n = size[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = np.frombuffer(b"".join(ids), "<i4")[np.repeat(first[word] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array((cuts + np.arange(len(cuts))).astype(np.int32)), pa.array(np.insert(flat, cuts[1:], end), pa.int32()))


@functools.cache
def _word_ids(name: str, path: str | None) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(name, path)


def _slices(column: pa.Array, most: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column with about ``most`` bytes each, at least one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    at = np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()) + most, most)) + 1
    cuts = np.unique(np.concatenate([[0], np.minimum(at, len(sizes)), [len(sizes)]]))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def write_tokens(docs: DataFrame, path: str, encoding: str = "dictionary", end: int = 2, name: str = "word_bpe_49k.json", tokenizer_path: str | None = None, row_group_mb: int = 32, page_kb: int = 256, page_rows: int = 512) -> None:
    """Encode all texts of ``docs (doc_id, text)`` and write them to Parquet files in ascending order of ``doc_id``.

    A file has ``seq`` (number of the file, then of the row in it: the order of all rows), ``doc_id``, ``n_tokens`` and ``ids``, a list
    of 32-bit integers that ends with ``end``. ``encoding`` of the ids is ``dictionary`` or ``delta``; the other columns are
    delta-encoded. Row groups hold ``row_group_mb``, pages ``page_kb`` or ``page_rows`` rows; the writer adds minima, maxima and
    offsets of pages to each file (page index), so that readers find the pages of a few documents, or read the other columns alone.
    Texts are dealt out by ranges of ``doc_id``, sorted and encoded where they are written; ties of ``doc_id`` go by a hash of the
    text, and repeats of one row are spread over ranges, so none grows with one id. Nulls come first; a null text is empty and has
    the end id alone. No rows give no tokens. Other columns are ignored.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(name, tokenizer_path)
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                lists = words.of(batch.column("text").slice(a, b - a), end)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pc.list_value_length(lists), lists], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
    order = [F.asc_nulls_first("doc_id"), "tie", "copy"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = sorted_.mapInArrow(run, f"doc_id {kind}, n_tokens int, ids array<int>")
    (
        encoded.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "n_tokens", "ids")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of token files, or only those with ``doc_id`` from ``first`` to ``last``: the scan skips the other row groups and pages."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def checksum(ids: str = "ids") -> Column:
    """Unsigned CRC-32 of a list of ids as 32-bit little-endian integers."""

    def crc(column: pa.Array) -> pa.Array:
        values, at = np.asarray(column.values).astype("<u4", copy=False), np.asarray(column.offsets)
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())

    crc.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(crc, "long")(ids)


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows (seq, n_tokens, ...)`` of token files with ``start``, the number of ids in all rows before.

    Sums run inside each file, and once over the files' totals, which are one row a file.
    """
    file = F.shiftrightunsigned("seq", ROW_BITS)
    totals = rows.groupBy(file.alias("file")).agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    earlier = (Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum(F.col("n_tokens").cast("long")).over(Window.partitionBy("file").orderBy("seq").rowsBetween(*earlier)), F.lit(0))
    return rows.withColumn("file", file).withColumn("inside", inside).join(broadcast_if(base), "file").withColumn("start", F.col("base") + F.col("inside")).drop("file", "inside", "base")


def token_table(docs: DataFrame, path: str, **format_: object) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all rows of ``docs``, from the files that ``write_tokens`` makes at ``path``."""
    write_tokens(docs, path, **format_)
    spark = docs.sparkSession
    sums = spark.read.parquet(path).select("seq", "doc_id", "n_tokens", checksum().alias("ids_crc32"))
    meta = with_starts(sums)
    return meta.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files in the shared folder, and what is read back from these."""
    return token_table(documents(spark, sf_dir), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
