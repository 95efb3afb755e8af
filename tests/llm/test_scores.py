"""Recurrent scores, ranked search and the divergence audit against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from .test_corpus import SCHEMA, docs, data, nothing, sets  # noqa: F401  (fixtures)

LOWER = {c: c + 32 for c in range(65, 91)}


# --- 11 --------------------------------------------------------------------------------------------------------------------------------------


def small_model(words=7, tail=3, classes=3, width=4, seed=0):
    from tidemark.llm import gru

    rng = np.random.default_rng(seed)
    layout = gru.Layout(np.sort(rng.integers(1, 50, words))[::-1].astype(float), rng.integers(0, 9, tail).astype(float), classes)
    params = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in gru.fresh(layout, width).items()}
    return layout, params


def test_outcomes_add_up_to_one():
    from tidemark.llm import gru

    layout, params = small_model()
    net = gru.Network(layout, params)
    h = np.tanh(np.random.default_rng(1).normal(size=(1, 4))).astype(np.float32)
    p = [math.exp(net.outputs(h, np.array([k]))[0][0]) for k in range(10)]
    assert sum(p) == pytest.approx(1, abs=1e-5)


def test_gradients_are_finite_differences():
    from tidemark.llm import gru

    layout, params = small_model()
    params = {k: v.astype(np.float64) for k, v in params.items()}
    ids = np.random.default_rng(2).integers(0, 10, 23).astype(np.uint16)
    starts, lengths = np.array([0, 9, 15]), np.array([9, 6, 8])

    def loss(p):
        feed, net = gru.Feed(ids, starts, lengths, 2), gru.Network(layout, p)
        (place, active), = feed.windows(100)
        seen, opens, told = gru._window(net, feed, place, active)
        return -net.outputs(np.concatenate(net.forward(seen, opens, np.zeros((2, 4)))), np.concatenate(told))[0].sum()

    feed, net = gru.Feed(ids, starts, lengths, 2), gru.Network(layout, params)
    (place, active), = feed.windows(100)
    seen, opens, told = gru._window(net, feed, place, active)
    keep = []
    states = net.forward(seen, opens, np.zeros((2, 4)), keep)
    grad = {k: np.zeros_like(v) for k, v in params.items() if k != "inputs"}
    _, dh = net.outputs(np.concatenate(states), np.concatenate(told), grad)
    net.backward(keep, np.split(dh, np.cumsum(active)[:-1]), grad)
    rows, g = grad.pop("inputs")
    grad["inputs"] = np.zeros_like(params["inputs"])
    grad["inputs"][rows] = g
    rng = np.random.default_rng(3)
    for k in gru.NAMES:
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in params[k].shape)
            moved = []
            for d in (1e-5, -1e-5):
                p = {x: v.copy() for x, v in params.items()}
                p[k][at] += d
                moved.append(loss(p))
            assert grad[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=2e-4), (k, at)


def test_state_goes_on_between_windows():
    from tidemark.llm import gru

    layout, params = small_model()
    net = gru.Network(layout, params)
    rng = np.random.default_rng(4)
    lengths = np.array([1, 40, 3, 500, 17, 1])
    starts = np.cumsum(lengths) - lengths
    ids = rng.integers(0, 10, lengths.sum()).astype(np.uint16)
    alone = []
    for s, n in zip(starts, lengths):
        h, total, before = np.zeros((1, 4), np.float32), 0.0, net.start
        for x in ids[s : s + n].tolist():
            (h,) = net.forward([np.array([before])], [np.array([False])], h)
            total += float(net.outputs(h, np.array([x]))[0][0])
            before = x
        alone.append(total)
    for n_lanes, steps in ((1, 7), (3, 16), (512, 32)):
        assert np.allclose(gru.log_likelihood(net, ids, starts, lengths, n_lanes, steps), alone, rtol=1e-4)


def tokens(text):
    return [w.translate(LOWER) for w in re.findall("[^\x20\x09-\x0d]+", text or "")] + [""]


@pytest.mark.parametrize("block_bytes", [3000, 1 << 23])
def test_recurrent_scores(spark, docs, data, nothing, block_bytes):  # noqa: F811
    from tidemark.llm.recurrent import score_documents

    found = score_documents(docs, block_bytes=block_bytes, head=64).collect()
    assert len(found) == len(data)
    learn = [t for i, t, *_ in data if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    wanted = sorted((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, t, *_ in data for w in [tokens(t)])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == wanted
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id, r.n_tokens].add(round(r.score, 3))
    assert len(by_id[7, len(tokens(data[7][1]))]) == 1  # repeated rows have one score
    assert score_documents(nothing).count() == 0
    only = docs.where("doc_id in (3)") if zlib.crc32(b"3") % 5 == 1 else docs.where("doc_id = 0" if zlib.crc32(b"0") % 5 == 1 else "false")
    assert all(np.isfinite(r.score) and r.train_tokens == 0 for r in score_documents(only).collect())  # nothing to train on


def test_recurrent_scores_beat_counts(spark):
    from tidemark.llm.recurrent import score_documents

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = score_documents(docs).where("held_out").agg({"base_score": "sum", "score": "sum", "doc_id": "count"}).first()
    assert out["count(doc_id)"] > 150 and out["sum(score)"] > out["sum(base_score)"] * 0.9


def test_outputs_hold_few_scores_at_once():
    """A window's class scores must stay in a core's cache: those of 16,384 rows at once are 6 MB."""
    import tracemalloc

    from tidemark.llm import gru

    layout, params = small_model(words=600, tail=32, classes=64, width=16)
    net, rng = gru.Network(layout, params), np.random.default_rng(5)
    h, told = np.tanh(rng.normal(size=(16384, 16))).astype(np.float32), rng.integers(0, 632, 16384)
    grad = {k: np.zeros_like(v) for k, v in params.items() if k != "inputs"}
    tracemalloc.start()
    logp, dh = net.outputs(h, told, grad)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16384 * layout.classes * 4
    parts = [net.outputs(h[k : k + 1000], told[k : k + 1000], {k: np.zeros_like(v) for k, v in grad.items()}) for k in range(0, 16384, 1000)]
    assert np.allclose(logp, np.concatenate([p for p, _ in parts]), atol=1e-4) and np.allclose(dh, np.concatenate([d for _, d in parts]), atol=1e-4)


@pytest.mark.parametrize("limit", [1, 150, 1 << 20])
def test_blocks_hold_every_token(monkeypatch, limit):
    import pyarrow as pa

    from tidemark.llm import recurrent

    class Task:
        get, partitionId = classmethod(lambda cls: cls), staticmethod(lambda: 3)

    monkeypatch.setattr(recurrent, "TaskContext", Task)
    monkeypatch.setattr(recurrent, "PIECE", 100 if limit == 1 else 1 << 22, raising=False)  # texts that come alone, in pieces
    said = ["", " ", "a", " A b\t\x0b\x0c\r\nB ", "\n\n", "\x1c\x85x\xa0Y \u2003Z \x00", "É é ÀA", "w " * 90, "end", "", "x" * 400 + " a", "a\x1fb"]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(said * 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["doc_id", "text"]) for part in (rows[:5], rows[5:6], rows[6:])]
    batches = [b.slice(1) if k == 2 else b for k, b in enumerate(batches)]
    rows = rows[:6] + rows[7:]
    found, blocks = [], list(recurrent._blocks(limit, 4)(iter(batches)))
    assert len(blocks) == (len(rows) if limit == 1 else len(blocks)) and (limit < 1 << 20 or len(blocks) == 1)
    for r in (b.to_pylist()[0] for b in blocks):
        codes = np.frombuffer(pa.decompress(r["codes"], sum(r["lengths"]) * 4, codec="zstd", asbytes=True), "<u4")
        assert r["words"][0] == b"" and len(set(r["words"])) == len(r["words"]) and len(codes) == sum(r["lengths"])
        own, at = Counter(), 0
        for i, n in zip(r["doc_ids"], r["lengths"]):
            found.append((i, [r["words"][k].decode() for k in codes[at : at + n]]))
            at += n
            own.update(found[-1][1] if i is None or zlib.crc32(str(i).encode()) % 5 != 1 else [])
        assert r["trained"] == [own[w.decode()] for w in r["words"]]
    assert found == [(i, tokens(t)) for i, t in rows]


# --- 12 --------------------------------------------------------------------------------------------------------------------------------------


def term_list(text, pattern="[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"):
    return [t.translate(LOWER) for t in re.findall(pattern, text or "")]


def ranked(data, items, top=10):
    terms = [(i, Counter(term_list(t))) for i, t, *_ in data]
    n_docs, total = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in terms:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(term_list(text)).items() if c[t])
            if s:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:top])]
    return out


def test_ranked_search(spark, docs, data, nothing):  # noqa: F811
    from tidemark.llm import ranked as op
    from tidemark.llm.common import Workspace

    rng = np.random.default_rng(1)
    items = [(k, " ".join(str(x) for x in rng.choice(data[int(rng.integers(0, 40))][1].split(), 12)) + " W1, w1;É") for k in range(25)]
    items += [(30, None), (31, ""), (32, "!!"), (33, "nowhereatall zzzz"), (34, BOILER_WORDS := "This long LICENCE line"), (34, "another text of one id w3 w5"), (None, "w1 w2 w3"), (35, "x" * 300_000), items[0], items[0]]
    assert BOILER_WORDS
    frame = spark.createDataFrame([(i, t, "q", 7) for i, t in items], "item_id long, text string, term string, query int")
    wanted = sorted(ranked(data, items), key=str)
    for shard_bytes, shard_docs, block_terms in ((1 << 23, 4096, 200_000), (4000, 4096, 20), (1 << 23, 5, 1)):
        work = Workspace(spark, "test")
        index = op.build_index(docs, work, shard_bytes, shard_docs)
        assert sorted((tuple(r) for r in op.search(index, frame, work, block_terms=block_terms).collect()), key=str) == wanted
    assert op.ranked_search(docs, frame).columns == ["item_id", "rank", "doc_id", "score"]
    assert op.ranked_search(nothing, frame).count() == 0 and op.ranked_search(docs, frame.limit(0)).count() == 0
    assert op.ranked_search(docs.where("text is null"), frame).count() == 0


def test_wide_rows_are_row_groups_of_their_own(spark, docs):  # noqa: F811
    import glob

    import pyarrow.parquet as pq

    from tidemark.llm import ranked as op
    from tidemark.llm.common import Workspace

    work = Workspace(spark, "wide")
    shards = op.build_index(docs.coalesce(1), work, shard_docs=5).count()
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(f"{work.path.removeprefix('file://').removeprefix('file:')}/index/*.parquet")]
    assert shards > 5 and sum(m.num_row_groups for m in footers) == shards == sum(m.num_rows for m in footers)


def test_ranked_search_ties_and_pruning():
    from tidemark.llm import ranked as op

    shard = op._Shard()
    rng = np.random.default_rng(2)
    words = [f"t{k}" for k in range(300)]
    for i in range(2000, 0, -1):  # ids fall, so later rows win ties
        shard.add(i if i % 400 else None, " ".join(rng.choice(words, 6)).encode() if i % 7 else b"alpha beta gamma")
    row = {c: shard.row().column(c)[0].as_py() for c in ("ids", "lengths", "terms", "ends", "docs", "uses")}
    block = op.Block([(0, b"alpha", 1), (0, b"beta", 2), (1, b"t1", 1), (1, b"t2", 1), (1, b"t3", 1)], {b"alpha": 5, b"beta": 5, b"t1": 900, b"t2": 800, b"t3": 700})
    tree = op.Tree(block, row, 2000, 12000)
    for q in (0, 1):
        lo, hi = block.cut[q], block.cut[q + 1]
        every = np.zeros(2000, np.int64)
        for t, w in zip(block.term[lo:hi], block.weight[lo:hi]):
            k = tree.own[t]
            every[tree.doc[tree.start[k] : tree.start[k + 1]]] += w * tree.value[tree.start[k] : tree.start[k + 1]]
        order = sorted((-int(s), i is None, i or 0) for s, i in zip(every, row["ids"]) if s)[:10]
        best = []
        scored = tree.search(tree.own[block.term[lo:hi]], block.weight[lo:hi], int(tree.roots(block)[q]), best, 10)
        assert sorted((-s, no == -1, -d) for s, no, d in best) == order
        assert q == 0 or scored < 1000  # most leaves are never opened


# --- 13 --------------------------------------------------------------------------------------------------------------------------------------


def divergence(data, min_docs, top=10):
    uses, groups = defaultdict(lambda: [0, Counter()]), defaultdict(Counter)
    for _, text, lang, source, *_ in data:
        c = Counter(term_list(text, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"))
        groups[lang or "", source or ""].update(c)
        for t, n in c.items():
            uses[lang or "", t][0] += 1
            uses[lang or "", t][1][source or ""] += n
    kept = defaultdict(list)
    for (lang, t), (df, _) in uses.items():
        if df >= min_docs:
            kept[lang].append(t)
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    out, p, all_ = [], {}, {}
    for lang, source in groups:
        v, c = len(kept[lang]), groups[lang, source]
        whole = {t: sum(uses[lang, t][1].values()) for t in kept[lang]}
        total, own = sum(whole.values()), sum(c[t] for t in kept[lang])
        p[lang, source] = {t: share(c[t], own, v) for t in kept[lang]}
        all_[lang] = {t: share(n, total, v) for t, n in whole.items()}
    for lang, source in groups:
        pairs = [(-sum(gap(p[lang, source][t], p[lang, o][t]) for t in kept[lang]), o.encode(), o) for g, o in groups if g == lang and o != source]
        out += [(lang, source, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(sorted(pairs))]
        terms = [(-gap(x, all_[lang][t]), t.encode(), t) for t, x in p[lang, source].items() if groups[lang, source][t] and x > all_[lang][t]]
        out += [(lang, source, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(sorted(terms)[:top])]
    return out


@pytest.mark.parametrize("sizes", [(4096, 64), (7, 2)])
def test_source_divergence(spark, docs, data, nothing, sizes):  # noqa: F811
    from tidemark.llm.divergence import source_divergence

    extra = [(200 + k, t, lang, s) for k, (t, lang, s) in enumerate([("déjà VU déjà", "fr", "a"), ("déjà", "fr", "b"), (None, "fr", "c"), ("12 34 ..", "xx", "a"), ("", "xx", "b")])]
    more = spark.createDataFrame([(*r, None, 1, "f", "s", 2, "t", 3) for r in extra], SCHEMA)
    for min_docs in (10, 1):
        found = [tuple(r) for r in source_divergence(docs.unionByName(more), min_docs, tile_terms=sizes[0], tile_groups=sizes[1]).collect()]
        assert sorted(found) == sorted(divergence([r[:4] for r in data] + extra, min_docs))
    assert source_divergence(nothing).count() == 0


def test_shares_are_exact():
    from tidemark.llm.divergence import shares

    rng = np.random.default_rng(0)
    total = np.concatenate([rng.integers(1, 10**6, 50), rng.integers(10**14, 9 * 10**15, 50)])
    count = (total * rng.random(100)).astype(np.int64)
    assert shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(count, total)]


# --- 7 ---------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 9, 64, 1001])
def test_running_sums_of_an_array(spark, n):
    from pyspark.sql import functions as F

    from tidemark.llm.chat import running

    x = np.random.default_rng(n).integers(0, 99, n).tolist()
    (r,) = spark.createDataFrame([(x,)], "x array<long>").select(running("x").alias("y"), F.size("x").alias("n")).collect()
    assert r["y"] == (np.cumsum(x) - x).tolist()


def test_a_very_long_conversation(spark):
    """100,000 turns of one conversation: work grows with the turns, not with their square."""
    import hashlib
    import time

    from pyspark.sql import functions as F

    from tidemark.llm.chat import conversation_digests

    n = 100_000
    text = lambda i: f"turn {i} says <|im_end|> and \\ no more, é"
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.format_string(text("%s").replace("turn %s", "turn %d"), "id").alias("text"))
    began = time.time()
    (r,) = conversation_digests(turns).collect()
    took = time.time() - began
    said = "".join(text(i) for i in range(n) if i % 3)
    assert r["n_turns"] == n and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert took < 60, took
