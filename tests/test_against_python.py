"""Queries without SQL against plain Python on the smallest tables."""

import re
from collections import Counter
from urllib.parse import urldefrag, urljoin, urlsplit

import numpy as np

import __spark_entry__ as driver
from factweave.plans import domain
from factweave.functions.text import KEYWORD_STOP, UNIT_STOP
from factweave.registry import QUERIES

driver.queries()
SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_document_types(spark):
    rules = (
        ("meeting_notes", r"\d{4}-\d{2}-\d{2}.*meeting|meeting.*\d{4}|minutes|attendees|action items"),
        ("changelog", r"changelog|release notes|what'?s new|v\d+\.\d+"),
        ("config", r"configuration|settings|parameters|defaults|\.toml|\.yaml|\.json|\.env"),
        ("api_reference", r"endpoint|request.*response|status code|rate limit|api reference|swagger"),
        ("policy", r"\bpolicy\b|\bmust\b.*\bshall\b|compliance|requirement|guideline"),
        ("architecture", r"architecture|design doc|component.*diagram|system design|adr|decision record"),
        ("guide", r"\bguide\b|tutorial|how to|getting started|step \d|walkthrough"),
    )
    kind = lambda t: next((n for n, p in rules if re.search(p, f" {t[:500]}".lower(), re.A)), "general")
    want = Counter(kind(r.text or "") for r in table(spark, "documents"))
    assert {r.doc_type: r.n for r in QUERIES["document_types"](spark, SF).collect()} == dict(want)


def test_hash_vectors(spark):
    def total(t):
        v = np.zeros(128)
        for w in re.findall("[a-z0-9]{3,}", t.lower()):
            h = 0
            for c in w:
                h = (h * 31 + ord(c)) % (1 << 32)
            v[abs(h - (1 << 32) if h >= 1 << 31 else h) % 128] += 1
        n = np.sqrt((v * v).sum())
        return float(np.float32(v / n if n else v).astype(float).sum())

    got = {(r.conv_id, r.turn): r.total for r in QUERIES["hash_vectors"](spark, SF).collect()}
    for r in table(spark, "conversations"):
        assert abs(got[r.conv_id, r.turn] - total(r.text or "")) < 2e-4


def test_page_links(spark):
    want = set()
    for r in table(spark, "pages"):
        for href in re.findall(r"""href=["']([^"'#]+)""", r.html, re.I):
            to = urldefrag(urljoin(r.url, href))[0]
            if urlsplit(to)[:2] == urlsplit(r.url)[:2]:
                want.add((r.page_id, to))
    assert {(r.page_id, r.target) for r in QUERIES["page_links"](spark, SF).collect()} == want


def test_similar_topics(spark):
    stop = {*KEYWORD_STOP, *UNIT_STOP}
    nodes = domain.nodes(spark, SF).collect()
    words = [{w for w in re.split(r"\W+", n.raw.lower()) if len(w) > 2 and w not in stop} for n in nodes]
    titles = [{w for w in re.split(r"\W+", n.title.lower()) if len(w) > 3} for n in nodes]
    want = Counter()
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes):
            if a.id < b.id and (a.source_id == b.source_id or titles[i] & titles[j] or len(words[i] & words[j]) >= 4):
                want[a.source_id] += 1
    assert {r.source_id: r.n for r in QUERIES["similar_topics"](spark, SF).collect()} == dict(want)


def test_entity_groups(spark):
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    nodes = domain.nodes(spark, SF).collect()
    for n in nodes:
        for e in n.entities:
            part[find(("e", e.name.lower()))] = find(("n", n.id))
    sizes = Counter(find(("n", n.id)) for n in nodes)
    assert sorted(r.n for r in QUERIES["entity_groups"](spark, SF).collect()) == sorted(n for n in sizes.values() if n > 1)


def test_vector_clusters(spark):
    rows = sorted(table(spark, "embeddings"), key=lambda r: r.vec_id)
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, free, want = x @ x.T > 0.4, set(range(len(rows))), {}
    for i in range(len(rows)):
        if i in free:
            took = {i} | {j for j in free if near[i, j]}
            if len(took) >= 3:  # too few: all stay free
                free -= took
                want[str(rows[i].vec_id)] = len(took)
    assert want and {r.cluster: r.n for r in QUERIES["vector_clusters"](spark, SF).collect()} == want


def test_lcs_scores(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    got = {r.item_id: r.f1 for r in QUERIES["lcs_scores"](spark, SF).collect()}
    for r in table(spark, "benchmark"):
        a, b = (re.findall("[a-z0-9]+", t.lower()) for t in (r.text, r.text[: len(r.text) // 2]))
        n = lcs(a, b)
        assert abs(got[r.item_id] - (2 * n / (len(a) + len(b)) if n else 0)) < 1e-5


def test_dataset_split(spark):
    got = {r.split: r.n for r in QUERIES["dataset_split"](spark, SF).collect()}
    assert sum(got.values()) == len(table(spark, "documents")) and 0.03 < got["validation"] / sum(got.values()) < 0.2


def test_markdown_chunks(spark):
    """Chunks hold every word of their document, in order, and their offsets run over their texts."""
    chunks = {}
    for r in sorted(QUERIES["markdown_chunks"](spark, SF).collect(), key=lambda r: r.ordinal):
        chunks.setdefault(r.doc_id, []).append(r)
    assert all([c.ordinal for c in v] == list(range(len(v))) and v[0].char_offset == 0 for v in chunks.values())
    assert len(chunks) == len([r for r in table(spark, "documents") if (r.text or "").strip()])


def test_packages(spark):
    rows = QUERIES["packages"](spark, SF).collect()
    assert rows and all(2 <= r.n_nodes <= 10 for r in rows) and sum(r.n_nodes for r in rows) <= len(table(spark, "part"))


def test_audit_counts(spark):
    """The audit's contradictions are at least the told ones that meet both nodes, and none is cut at a report's cap."""
    got = {(r.detector, r.severity): r.n for r in QUERIES["audit"](spark, SF).collect()}
    told = QUERIES["told_contradictions"](spark, SF).count()
    assert sum(n for (d, _), n in got.items() if d == "contradictions") > max(50, told)
