"""Stages on hard tables, and searches against exhaustive ones."""

from collections import defaultdict

import numpy as np
import pytest

from .test_corpus import SCHEMA, data, docs, nothing, shingle_set  # noqa: F401  (fixtures)


def edit_distance(p, t):
    """Least edits of p to any run of t, and nothing clever."""
    row = np.zeros(len(t) + 1, np.int64)
    for i, x in enumerate(p, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in t], np.int64))
        out = np.empty(len(t) + 1, np.int64)
        out[0] = i
        for j in range(len(t)):
            out[j + 1] = min(new[j], out[j] + 1)
        row = out
    return int(row.min())


def test_leaks_equal_quadratic_search_at_the_whole_budget(spark):
    """Substitutions, insertions and deletions up to a fifth of an item's words, and one edit more; every pair of text and item is searched in full."""
    from tidemark.llm.leaks import find_leaks

    rng = np.random.default_rng(9)
    vocab = [f"v{i}" for i in range(900)]
    items = [(i, rng.choice(vocab, int(rng.integers(8, 45))).tolist()) for i in range(24)]
    texts = []
    for j in range(90):
        i, words = items[j % 24]
        words, budget = list(words), len(words) // 5
        edits = budget if j % 3 else budget + 1
        for _ in range(edits):
            at, kind = int(rng.integers(0, len(words))), ("sub", "del", "ins")[int(rng.integers(0, 3))]
            if kind == "del" and len(words) > 4:
                del words[at]
            elif kind == "ins":
                words.insert(at, f"new{j}x{at}")
            else:
                words[at] = f"new{j}y{at}"
        texts.append((j, rng.choice(vocab, 12).tolist() + words + rng.choice(vocab, 12).tolist()))
    wanted = {(j, i): d for j, t in texts for i, p in items if (d := edit_distance(p, t)) <= len(p) / 5}
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")
    found = find_leaks(spark.createDataFrame([(j, " ".join(t)) for j, t in texts], "doc_id long, text string"), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found}
    assert set(got) <= set(wanted) and all(wanted[k] == d for k, d in got.items())
    assert len(wanted) > 50 and len(got) / len(wanted) >= 0.95, (len(got), len(wanted))


def test_near_dedup_recall_and_shares(spark, capsys):
    """All pairs of distinct shingle sets of sf0.01 at a similarity of 0.8 by an inverted index, against what the trie alone and both ways link."""
    from tidemark.llm import similar

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = list({shingle_set(t): None for _, t in rows})
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = defaultdict(int)
    for ks in holders.values():
        for a in range(len(ks)):
            for b in range(a):
                shared[ks[b], ks[a]] += 1
    pairs = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]

    def linked():
        return similar.keep_similar(spark.createDataFrame(rows, "doc_id long, text string")).count()

    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(b)] = find(a)
    components = len({find(k) for k in range(len(sets))})
    both = linked()
    members = similar.band_members
    try:
        similar.band_members = lambda *a: members(*a).where("false")
        trie = linked()
    finally:
        similar.band_members = members
    merged = len(sets) - components
    with capsys.disabled():
        print(f"\nnear_dedup on sf0.01: {len(pairs)} pairs at 0.8 make {merged} merges; both ways find {len(sets) - both}, the trie alone {len(sets) - trie}")
    assert merged and (len(sets) - both) / merged >= 0.99 and both == components


def test_pipeline_on_hard_rows(spark, docs, data, nothing):  # noqa: F811
    """Nulls, repeated rows, clashing columns, ties, a text of 20 MB; and an empty table: no stage crashes, loses a column or alters a row."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path = "/root/testdata/sf0.001"
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(words[i] for i in rng.integers(0, 5000, 3_600_000))
    assert len(long) > 20_000_000
    whole = docs.unionByName(spark.createDataFrame([(77_777, long, "en", "s1", None, 1, "f", "s", 2, "t", 3)], SCHEMA))
    for c in ("m", "block", "blob", "sk", "h", "rows", "stay_id", "finish"):
        whole = whole.selectExpr("*", f"'x' as {c}")
    texts = {(d, t) for d, t, *_ in data} | {(77_777, long)}
    kept = whole
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path)
        assert kept.columns == whole.columns, name
    out = kept.select("doc_id", "text", "m", "rows").collect()
    assert {(r["doc_id"], r["text"]) for r in out} <= texts and all(r["m"] == r["rows"] == "x" for r in out)
    assert any(r["doc_id"] == 77_777 for r in out)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, path)
    assert last.count() == len(out)
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, path)
        assert empty.count() == 0
