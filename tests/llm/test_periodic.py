"""Periodic runs (operator 12) against plain enumeration."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from factweave.llm import periodic
from tests.llm.test_operators import AWKWARD, SCHEMA, SF, awkward, frame


def plain_runs(w, least=12):
    """Maximal stretches by trying every period, smallest first."""
    out, number = {}, {}
    w = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    for p in range(1, len(w) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], w[:-p] == w[p:], [False]]).astype(int)))
        for i, j in edge.reshape(-1, 2).tolist():
            if j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)
    return sorted((s, n, p) for (s, n), p in out.items())


def plain(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
    found = plain_runs(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digests = ["".join(f"{s},{m},{p}\n" for s, m, p in sorted(found, key=lambda r: (r[0], r[2]))), " ".join(w for i, w in enumerate(words) if i not in gone)]
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


def repeated(seed):
    """Texts over few words, some with a period in a period."""
    r = random.Random(seed)
    n, k = r.choice([0, 1, 11, 12, 30, 100, 300]), r.choice([1, 2, 3, 20])
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randint(0, 2)):
        if n:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 9)
            w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    return w


@pytest.mark.parametrize("clash", [False, True])
def test_runs(monkeypatch, clash):
    """With all block hashes equal as well, so that blocks are sorted by their words."""
    if clash:
        monkeypatch.setattr(periodic.np.random, "default_rng", lambda _: type("Zero", (), {"integers": lambda *a, **k: np.full(periodic.CYCLE, (1 << 64) - 1, np.uint64) * np.uint64(1 << 63)}))
    for trial in range(60):
        texts = sorted((repeated(trial * 10 + k) for k in range(trial % 7 + 1)), key=len)
        flat, ends = [], []
        for k, w in enumerate(texts):
            flat += [*w, -1000 - k]
            ends.append(len(flat) - 1)
        got = zip(*(x.tolist() for x in periodic.runs(np.array(flat), np.array(ends))), strict=True)
        assert sorted(got) == sorted((e - len(w) + s, n, p) for w, e in zip(texts, ends, strict=True) for s, n, p in plain_runs(w))


def test_extensions():
    r = random.Random(3)
    w = np.array([r.randrange(2) for _ in range(300)] + [0] * 200 + [r.randrange(3) for _ in range(100)])
    e = periodic.Extensions(w)
    a, b = np.triu_indices(len(w), 1)
    pick = np.random.default_rng(1).choice(len(a), 5000)
    for i, j, got in zip(a[pick].tolist(), b[pick].tolist(), e.of(a[pick], b[pick]).tolist(), strict=True):
        want = 0
        while j + want < len(w) and w[i + want] == w[j + want]:
            want += 1
        assert got == want


def test_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = periodic.op12_periodic_runs(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(plain(r["doc_id"], r["text"], True) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_awkward_rows(spark):
    df = awkward(spark)
    got = periodic.periodic_runs(df, plant=True).collect()
    want = [plain(r["doc_id"], r["text"], True) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    """Texts of over one lot, alone and with others; a text of one word repeated."""
    line = "the same few words again and again and more".split()
    texts = [" ".join(line * 12_000 + ["end"]), "a " * 50_000, *AWKWARD[:3]]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(frame(spark, texts)).collect()}
    assert tuple(got[0])[1:6] == (1, 0, 108_000, 9, 12_000_000)
    assert tuple(got[1])[1:6] == (1, 0, 50_000, 1, 50_000_000)
    assert got[1]["collapsed_sha256"] == hashlib.sha256(b"a").hexdigest()
