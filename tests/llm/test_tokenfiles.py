"""Token files (operator 13) against the tokenizer itself, and what their readers read."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factweave.llm import tokenfiles
from tests.llm.test_operators import AWKWARD, SCHEMA, SF, awkward, frame, prose

ODD = ["a\x1cb \x85c\xa0d e", "é ́ ẍ́", "<|endoftext|> <|startoftext|>x<|ENDOFTEXT|>", "it's 'S 'LL we'll 3²½", "İstanbul ΑΣ ẞ", "각 가", "zero​width﻿", "\x0b\x0c\r\n", "漢字かな 🙂🙂", "a" * 5000]


TOKENIZER = Tokenizer.from_file(tokenfiles.vocabulary())


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows):
    """In ascending doc_id order: ``doc_id, start, n_tokens, ids_crc32``."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = plain(text)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tmp_path, encoding):
    texts = [*AWKWARD, *ODD, *(prose(random.Random(i).randint(0, 80), i) for i in range(200))]
    df = frame(spark, texts).repartition(7)
    got = tokenfiles.token_table(df, f"{tmp_path}/t", encoding=encoding, page_rows=20).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(list(enumerate(texts)))
    back = tokenfiles.read_tokens(spark, f"{tmp_path}/t").orderBy("seq").collect()
    assert [r["doc_id"] for r in back] == list(range(len(texts)))
    assert [r["ids"] for r in back] == [plain(t) for t in texts]


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = tokenfiles.op13_token_files(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected([tuple(r) for r in rows])


def test_ties_and_extra_columns(spark, tmp_path):
    """Repeated ids and rows each keep a range of their own, nulls come first, other columns don't matter."""
    df = awkward(spark)
    df = df.unionByName(df.where("doc_id = 5"))
    got = tokenfiles.token_table(df, f"{tmp_path}/t").orderBy("start").collect()
    assert len(got) == df.count()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    want = sorted((i, n, c) for i, _, n, c in expected([tuple(r) for r in df.where("doc_id is not null").select("doc_id", "text").collect()]))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == want


def test_no_rows(spark, tmp_path):
    assert tokenfiles.token_table(spark.createDataFrame([], SCHEMA), f"{tmp_path}/t").count() == 0


def test_layout(spark, tmp_path):
    """Encodings, several row groups and pages, and the page index are in the files."""
    df = frame(spark, [prose(200, i) for i in range(600)]).coalesce(1)
    for encoding, used in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = f"{tmp_path}/{encoding}"
        tokenfiles.write_tokens(df, path, encoding=encoding, row_group_mb=1, page_rows=50)
        seen = [pq.ParquetFile(f).metadata for f in sorted(Path(path).glob("*.parquet"))]
        groups = [m.row_group(k) for m in seen for k in range(m.num_row_groups)]
        for g in groups:
            columns = {g.column(c).path_in_schema: g.column(c) for c in range(g.num_columns)}
            assert used in columns["ids.list.element"].encodings
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("seq", "doc_id", "n_tokens"))
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    with pytest.raises(ValueError):
        tokenfiles.write_tokens(df, f"{tmp_path}/x", encoding="plain")


def test_selective_reads(spark, tmp_path):
    """A range of documents is filtered in the scan; metadata are read without the ids."""
    tokenfiles.write_tokens(frame(spark, [prose(50, i) for i in range(300)]), f"{tmp_path}/t", row_group_mb=1, page_rows=10)
    few = tokenfiles.read_tokens(spark, f"{tmp_path}/t", 40, 44)
    assert [r["doc_id"] for r in few.orderBy("seq").collect()] == [40, 41, 42, 43, 44]
    plan = few._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,40), LessThanOrEqual(doc_id,44)" in plan
    meta = tokenfiles.with_starts(tokenfiles.read_tokens(spark, f"{tmp_path}/t").select("seq", "doc_id", "n_tokens"))
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert meta.agg(F.max("start")).first()[0] > 0
