"""Helpers shared by the training-text operators."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words, and the characters that part alphanumeric words.
BLANK = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case of letters, and that differ from each other."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text: Column) -> Column:
    """Lower-case alphanumeric words of ``text`` (null: none), punctuation dropped."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart that share an id but not a text; repeated rows stay one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of the runs of ``k`` words, in order; none where there are fewer words."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))),
    ).otherwise(F.array().cast("array<bigint>"))


def _spread(lane: int) -> int:
    """A long with the lowest bit of every lane set."""
    return sum(1 << b for b in range(0, 64, lane))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _simhash(hashes: Column, lane: int) -> Column:
    """SimHash of up to ``2 ** (lane - 1) - 1`` hashes, counted in packed lanes of ``lane`` bits."""
    ones = _signed(_spread(lane))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{s}") for s in range(lane)])
    sums = F.aggregate(
        hashes,
        zero,
        lambda acc, h: F.struct(*[(acc[f"c{s}"] + F.shiftrightunsigned(h, s).bitwiseAND(F.lit(ones))).alias(f"c{s}") for s in range(lane)]),
    )
    # adding this to a lane sets its highest bit if its count is over half; by halves, so that nothing overflows
    bias = F.lit((1 << (lane - 1)) - 1) - F.floor(F.size(hashes) / 2)
    half, top = _spread(lane) & 0xFFFFFFFF, (_spread(lane) << (lane - 1)) & 0xFFFFFFFF

    def bits(acc: Column) -> Column:
        def part(s: int, at: int) -> Column:
            lanes = F.shiftrightunsigned(acc[f"c{s}"], at).bitwiseAND(F.lit(0xFFFFFFFF))
            over = (lanes + (bias * F.lit(half)).cast("long")).bitwiseAND(F.lit(top))
            return F.shiftleft(F.shiftrightunsigned(over, lane - 1), s + at)

        return reduce(lambda a, b: a.bitwiseOR(b), [part(s, at) for s in range(lane) for at in (0, 32)])

    return F.element_at(F.transform(F.array(sums), bits), 1)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of longs: a bit is set if it is set in over half of them; empty: zero.

    Only built-in functions: the counts of all bits are kept in packed lanes, wide ones only for long arrays.
    """
    n = F.size(hashes)
    return F.when(n <= 127, _simhash(hashes, 8)).when(n <= 32767, _simhash(hashes, 16)).otherwise(_simhash(hashes, 32))


def bit_slice(x: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of longs, one per choice of ``blocks - radius`` of ``blocks`` parts of a fingerprint.

    Fingerprints that differ in at most ``radius`` bits agree in at least ``blocks - radius`` parts (pigeonhole),
    so they share a key. The choice's number is hashed into the key.
    """
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    at = [sum(width[:i]) for i in range(blocks)]
    return F.array(
        *[
            F.xxhash64(F.lit(c), *[bit_slice(fp, at[i], width[i]) for i in chosen])
            for c, chosen in enumerate(combinations(range(blocks), blocks - radius))
        ]
    )
