"""What operator 5 keeps on disk while whole texts are moved."""

import os

from factweave.llm import chunks


def test_chunks_are_gone_before_texts_are_moved(spark, monkeypatch):
    staged, left = [], []
    stage, extended = chunks.stage, chunks._extended

    def recorded(df, name):
        out = stage(df, name)
        staged.append((name, out._staged_at))
        return out

    def looked(matches, docs):
        left.extend(name for name, path in staged if os.path.exists(path.removeprefix("file:")))
        return extended(matches, docs)

    monkeypatch.setattr(chunks, "stage", recorded)
    monkeypatch.setattr(chunks, "_extended", looked)
    passage = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"first {passage}"), (2, f"another start {passage} and end")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in chunks.dedup_substrings(docs).collect()}
    assert got[1] == 0 and got[2] >= len(passage) - 2
    assert "chunk-repeats" in left and not {"chunks", "chunks-several", "chunk-digests"} & set(left)


def test_matches_are_extended_in_slices(spark, monkeypatch):
    """Kept texts are moved a slice at a time, and passages kept in any slice are cut whole."""
    rows, size = [], {}
    for k in range(12):
        passage = " ".join(f"item{k}x{i}" for i in range(40))
        rows += [(k, f"start {k} {passage}"), (100 + k, f"other {k * 7} start of it {passage} and end {k}")]
        size[100 + k] = len(passage)
    moved, put = [], chunks.stage

    def counting(df, name):
        out = put(df, name)
        if name == "chunk-extended":
            moved.append({x.kept_in for x in out.collect()})
        return out

    monkeypatch.setattr(chunks, "stage", counting)
    got = {r.doc_id: r.n_removed for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(moved) > 1 and all(moved) and sum(map(len, moved)) == len(set().union(*moved)) == 12
    assert all(got[k] == 0 and got[100 + k] >= size[100 + k] for k in range(12))
