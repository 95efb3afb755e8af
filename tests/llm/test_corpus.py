"""Corpus operators against brute force on a table of hard cases, and on empty tables."""

import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, spans string, row int, th string, taken int"
BOILER = "This long licence line is shared by very many documents here.\n"
PASSAGE = " ".join(f"shared{i} passage" for i in range(40))


def rows():
    rng = np.random.default_rng(5)
    vocab = ["w%d" % i for i in range(400)] + ["É", "naïve", "日本語", "a'b"]

    def prose(n):
        return " ".join(rng.choice(vocab, n)) + "."

    out = []
    for i in range(40):
        body = prose(int(rng.integers(5, 120)))
        if i % 3 == 0:
            body = (BOILER if i % 2 else "  " + BOILER.upper().strip() + "\t\n") + body
        if i % 5 == 0:
            body += " " + PASSAGE + " " + prose(9)
        out.append([i, body, "en" if i % 4 else None, f"s{i % 3}" if i % 7 else None])
    out += [[50 + i, out[5][1], "en", "s0"] for i in range(12)]  # exact copies
    out += [[70 + i, out[6][1] + f" tail{i}", "en", "s0"] for i in range(12)]  # near copies
    out += [[90, None, None, None], [91, "", "en", "s1"], [92, "\n\n", "en", "s1"], [93, " \t ", "", ""], [None, "no id at all here today", "en", "s2"], [None, None, None, None]]
    out += [[94, "x" * 300_000, "en", "s1"], [95, prose(30_000), "en", "s1"]]  # very long
    out += [list(out[7]), list(out[7])]  # repeated rows
    out += [[3, prose(30), "en", "s1"]]  # one id, another text
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    full = [(d, t, lang, s, None, 1, "f", "s", 2, "t", 3) for d, t, lang, s in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, x) if not isinstance(x, (list, tuple)) else (False, str(x)) for x in r)


def sets(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def expect(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


# --- 1 ---------------------------------------------------------------------------------------------------------------------------------------


def test_elias_fano():
    from tidemark.llm.token_ids import EliasFano

    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (7, 3), (1000, 5), (1000, 10**9), (5000, 2**40)):
        v = np.sort(rng.integers(0, top, n))
        f = EliasFano.from_bytes(EliasFano.encode(v).to_bytes())
        assert f.select(np.arange(n)).tolist() == v.tolist()
        for i in range(0, n, max(1, n // 50)):
            assert f.select(i) == v[i]
        if n > 2:
            assert len(f.to_bytes()) * 8 < n * (3 + max(1.0, np.log2(top / n))) + 64 * 6
            assert f.owner(int(v[n // 2])) == int((v <= v[n // 2]).sum())
    with pytest.raises(ValueError):
        EliasFano.encode([2, 1])


def test_encoder_is_exact():
    import public_tokenizers
    from tidemark.llm.token_ids import Encoder
    from tokenizers import Tokenizer

    texts = [r[1] or "" for r in rows() if r[1] is None or len(r[1]) < 5000]
    texts += ["  a", "x\n\n y", " don't '  s", "é  x", "a b c d", "日本語 text's\r\n  z ", "a'sam 12ab 3.4\n\nQ", " \n", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b", "<|endoftext", "tab\tx\x0b\x0cy\x85z", "a\n b", "1\n2 \n 3", "naïve café\nÉcole", "x" * 200]
    rng = np.random.default_rng(1)
    alphabet = list("ab c.\n\t'1Éß 日—!") + [" ", "\n", "'s"]
    texts += ["".join(rng.choice(alphabet, int(rng.integers(1, 60)))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(public_tokenizers.path(name))
        assert e.by_piece == (name == "byte_bpe_50k.json")
        library = Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(2):  # cold and from the memo
            ids, n = e(pa.array(texts))
            wanted = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
            assert n.tolist() == [len(x) for x in wanted]
            assert ids.tolist() == [i for x in wanted for i in x]


def test_memo_compares_bytes(monkeypatch):
    """Pieces whose hashes collide keep their own ids."""
    import public_tokenizers
    from tidemark.llm import token_ids
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_ids, "span_hashes", lambda data, start, end: ((end - start) % 3).astype(np.uint64))
    e, library = token_ids.Encoder(path), Tokenizer.from_file(path)
    texts = ["the cat sat on the mat", "some other words here", "the cat and unbelievable international", "abcdefgh abcdefgi abcdefghi"]
    for _ in range(2):
        ids, n = e(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_token_files(spark, docs, data, tmp_path):
    import public_tokenizers
    from tidemark.llm.token_ids import read_tokens, token_digests, write_tokens
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = write_tokens(docs, str(tmp_path / "t"), path, block_ids=500)
    e = Tokenizer.from_file(path)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, xxh(r[1] or "")))
    at, wanted, ids_of = 0, [], []
    for d, t, *_ in order:
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 0]
        wanted.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_of.append((d, at, ids))
        at += len(ids)
    expect(token_digests(spark, out).collect(), wanted)
    expect([(r[0], r[1], list(r[2])) for r in read_tokens(spark, out).collect()], ids_of)
    assert spark.read.parquet(out + "/blocks").count() > 5


def xxh(text):
    return np.array([xxhash.xxh64_intdigest(text.encode(), 42)], np.uint64).view(np.int64)[0]


# --- 2 ---------------------------------------------------------------------------------------------------------------------------------------


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, budget=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fl = sorted(root)
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if (a ^ b).bit_count() <= budget:
                root[find(a)] = find(b)
    return {f: find(f) for f in fl}


def test_simhash(docs, data):
    from tidemark.llm.simhash import near_duplicates

    fps = [simhash(t) for _, t, *_ in data]
    comp = components(set(fps))
    least = {}
    for (d, *_), f in zip(data, fps):
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    expect(near_duplicates(docs).collect(), [(d, f"{f:016x}", least.get(comp[f])) for (d, *_), f in zip(data, fps)])


@pytest.mark.parametrize("cap", [100_000, 3])
def test_trie_join_finds_all_links(spark, cap):
    from tidemark.llm.common import Workspace
    from tidemark.llm.components import connected_components
    from tidemark.llm.simhash import trie_links

    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    fps = set(seeds.tolist()) | {0, (1 << 64) - 1}
    for s in seeds.tolist():
        for _ in range(6):
            s ^= 1 << int(rng.integers(0, 64))
            s ^= (1 << int(rng.integers(0, 64))) * int(rng.integers(0, 2))
            fps.add(s)
    fps |= {int(seeds[0]) ^ (a << 40) for a in range(64)}  # one large prefix
    work = Workspace(spark, "test")
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {r["node"]: r["component"] for r in connected_components(trie_links(df, work, 2, cap), work).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        groups[found.get(s, s)].add(f)
    for f, c in components(fps).items():
        wanted[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_row_blocks_do_not_depend_on_batches():
    from tidemark.llm.common import row_blocks

    rng = np.random.default_rng(6)
    texts = [None if i % 9 == 0 else "é" * int(n) for i, n in enumerate(rng.integers(0, 400, 300))]
    whole = pa.record_batch({"doc_id": pa.array(range(300)), "text": pa.array(texts), "more": pa.array(range(300))})
    cut = lambda n: [whole.slice(i, n) for i in range(0, 300, n)]
    found = [[(name, [x for rows, _ in held for x in rows.column("doc_id").to_pylist()]) for name, held in row_blocks(iter(cut(n)), 5000)] for n in (1, 7, 64, 300)]
    assert found[0] == found[1] == found[2] == found[3] and [x for _, ids in found[0] for x in ids] == list(range(300))
    assert len({name for name, _ in found[0]}) == len(found[0]) > 10


@pytest.mark.parametrize("bucket", [2048, 3])
def test_near_dedup_stage_keeps_one_of_each_similar_group(spark, docs, data, monkeypatch, bucket):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tidemark.llm import similar

    monkeypatch.setattr(similar, "BUCKET", bucket)
    rng = np.random.default_rng(11)
    rows = [(d, t) for d, t, *_ in data]
    for g in range(25):  # copies with a few words changed, around the similarity of 0.8
        words = rng.choice(["v%d" % i for i in range(3000)], int(rng.integers(40, 300))).tolist()
        for c in range(6):
            copy = list(words)
            for i in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 30))):
                copy[i] = f"edit{g}x{c}x{i}"
            rows.append((10_000 + 10 * g + c, " ".join(copy)))
    more = docs.select(*docs.columns).unionByName(spark.createDataFrame([(d, t, "en", "s", None, 1, "f", "s", 2, "t", 3) for d, t in rows[len(data) :]], SCHEMA))
    sets = sorted({shingle_set(t) for _, t in rows}, key=len)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = len(a & b)
            if 5 * shared >= 4 * (len(a) + len(b) - shared):
                root[find(i)] = find(j)
    of = {s: find(i) for i, s in enumerate(sets)}
    least = {}
    for d, t in rows:
        k = of[shingle_set(t)]
        at = (d is None, d or 0)
        least[k] = min(at, least.get(k, at))
    kept = corpus_pipeline.near_dedup(spark, more, "")
    assert kept.columns == docs.columns
    expect([((r["doc_id"] is None, r["doc_id"] or 0),) for r in kept.collect()], [(x,) for x in least.values()])


@pytest.mark.parametrize("without", ["band_members", "trie_members"])
def test_near_dedup_stage_links_by_the_trie_and_by_bands(spark, monkeypatch, without):
    """Long copies with one changed word lie within the trie's bits and share bands: either way alone finds them, and texts apart stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tidemark.llm import similar

    members = getattr(similar, without)
    monkeypatch.setattr(similar, without, lambda *a: members(*a).where("false"))
    rng, rows = np.random.default_rng(5), []
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 600)]
        rows += [(10 * g + c, " ".join([*words[: 40 * c], f"new{g}", *words[40 * c + 1 :]]) if c else " ".join(words)) for c in range(4)]
        rows.append((10 * g + 9, " ".join(words[:300] + [f"z{x}" for x in rng.integers(0, 5000, 300)])))  # half of it: not similar
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(10 * g + c for g in range(12) for c in (0, 9))


def test_similar_links_finds_chains():
    from tidemark.llm.similar import similar_links

    chain = [np.arange(i * 5, i * 5 + 100, dtype=np.uint64) for i in range(12)]  # neighbours share 95 of 105
    other = [np.arange(10_000 + i * 5, 10_100 + i * 5, dtype=np.uint64) for i in range(4)]
    group = similar_links([chain[i] for i in (0, 11, 5, 3, 8, 1, 10, 2, 9, 4, 7, 6)] + other)
    assert len(set(group[:12])) == 1 and len(set(group[12:])) == 1 and group[0] != group[12]


# --- 3 ---------------------------------------------------------------------------------------------------------------------------------------


def vectors(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[20:60] = v[20]  # a common vector
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(n)]
    rows += [(1000, None, 0), (1050, [0.0] * dim, 0), (1100, [float("nan")] * dim, 0), (1150, [None] * dim, 0), (1200, [1.0], 0), (None, rows[3][1], 0), (50, rows[50][1], 0)]
    return rows, v


def brute(rows, every=50, k=5):
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i in ids[ids % every == 0]:
        s = m @ m[np.searchsorted(ids, i)]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_hilbert_neighbours(spark):
    from tidemark.llm.curves import hilbert_keys, nearest

    grid = np.array([[x, y] for x in range(16) for y in range(16)])
    walk = grid[np.argsort(hilbert_keys(grid, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # a curve: each step moves to a neighbour
    rows, _ = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    wanted = brute(rows)
    found = defaultdict(list)
    for r in nearest(df, window=10_000).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(wanted)
    for q, w in wanted.items():
        assert [i for i, _ in found[q]] == [i for i, _ in w]
        assert np.allclose([s for _, s in found[q]], [s for _, s in w], atol=1e-12)
    hit = [len({r["vec_id"] for r in g} & {i for i, _ in wanted[q]}) for q, g in _by(nearest(df).collect()).items()]
    assert sum(hit) / (5 * len(wanted)) >= 0.9
    # short vectors are compared with their own; scaled copies are ranked by the formula itself, whatever the batches
    short = [(2000 + 25 * i, [float(x) for x in np.random.default_rng(i).normal(size=3)], 0) for i in range(8)]
    scaled = [(3000 + i, [x * (1 + i / 7) for x in rows[5][1]], 0) for i in range(60)]
    more = rows + [(i, [float(np.float32(x)) for x in v], r) for i, v, r in short + scaled]
    both = [sets(nearest(spark.createDataFrame(more, "vec_id long, embedding array<float>, rank int").repartition(p), window=10_000)) for p in (1, 6)]
    assert both[0] == both[1]
    by_id = {i: np.array(v, float) for i, v, _ in more if i is not None and v and None not in v}
    fixed = lambda x, y: functools.reduce(lambda s, p: s + p[0] * p[1], zip(x.tolist(), y.tolist()), 0.0)  # noqa: E731  (sum() compensates)
    for q, rank, i, score in both[0]:
        x, y = by_id[q], by_id[i]
        assert len(x) == len(y) and score == fixed(x, y) / (math.sqrt(fixed(x, x)) * math.sqrt(fixed(y, y)))
        if q in (2000, 2050, 2100, 2150):
            assert 2000 <= i < 2200
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank int")
    assert len(nearest(few).collect()) == 2
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_hilbert_neighbours_of_any_magnitude(spark):
    """Finite vectors take part however small or large: scores equal exact rational arithmetic, to the last places of a double."""
    from fractions import Fraction

    from tidemark.llm.curves import nearest

    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        v = rng.normal(size=6) * 10.0 ** (-170, 200, 0, -320, 307)[i % 5]
        if i % 7 == 0:
            v[:3] *= 1e-150  # mixed within a vector
        rows.append((i, [float(x) for x in v if np.isfinite(x)]))
    rows = [(i, v) for i, v in rows if len(v) == 6 and any(v)]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, window=1000).collect()
    exact = {i: [Fraction(x) for x in v] for i, v in rows}

    def score(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        square = dot(exact[a], exact[b]) ** 2 / (dot(exact[a], exact[a]) * dot(exact[b], exact[b]))
        return math.copysign(math.sqrt(square), dot(exact[a], exact[b]))

    for q in (i for i, _ in rows if i % 10 == 0):
        wanted = sorted((-score(q, i), i) for i, _ in rows if i != q)[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [i for _, i, _ in own] == [i for _, i in wanted]
        assert np.allclose([s for *_, s in own], [-s for s, _ in wanted], atol=1e-14)


def _by(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["query_id"]].append(r)
    return out


# --- 4, 5 ------------------------------------------------------------------------------------------------------------------------------------


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup(docs, data, limit):
    from tidemark.llm.lines import duplicate_lines

    def k(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    n, keep, held = Counter(), {}, set()
    for d, t, *_ in data:
        for x in {k(line) for line in (t or "").split("\n")}:
            if len(x) >= 40:
                n[x] += (d, x) not in held
                held.add((d, x))
                keep[x] = max((y for y in (keep.get(x), d) if y is not None), default=None)
    wanted = []
    for d, t, *_ in data:
        lines = (t or "").split("\n")
        left = [line for line in lines if not (n[k(line)] >= 5 and keep[k(line)] != d)]
        wanted.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    expect(duplicate_lines(docs, max_filter_bytes=limit).collect(), wanted)


@pytest.mark.parametrize("unit", ["line", "sentence", "paragraph"])
@pytest.mark.parametrize("least", [5, 25])
def test_unit_dedup(docs, data, unit, least):
    from tidemark.llm.units import repeated_units

    cut = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "paragraph": r"(?s).*?\n\n|.+"}[unit]
    occ = defaultdict(list)
    texts = []
    for d, t, *_ in data:
        t = t or ""
        units = []
        for m in re.finditer(cut, t):
            body = re.sub(r"[.!?]", " ", m.group()) if unit == "sentence" else m.group()
            w = [low(x) for x in re.split(r"[\x20\x09-\x0D]+", body) if x]
            if w:
                units.append((m.start(), m.end(), len(w)))
                occ[" ".join(w)].append((d is None, d or 0, xxh(t), m.start()))
        texts.append((d, t, units))
    gone = {o for v in occ.values() for o in set(v) if o != min(v)}
    wanted = []
    for d, t, units in texts:
        runs = []
        for again, run in itertools.groupby(units, lambda u: (d is None, d or 0, xxh(t), u[0]) in gone):
            run = list(run)
            if again and sum(n for *_, n in run) >= least:
                runs.append((run[0][0], run[-1][1]))
        kept, at = "", 0
        for a, b in runs:
            kept += t[at:a]
            at = b
        wanted.append((d, str(tuple(runs) or None), kept + t[at:]))
    assert any(r[1] != "None" for r in wanted)
    expect([(r["doc_id"], str(tuple((s["start"], s["end"]) for s in r["removed"]) if r["removed"] else None), r["kept"]) for r in repeated_units(docs, unit, least).collect()], wanted)


def test_unit_dedup_meets_passages_within_lines(spark):
    """A passage from mid-line to mid-line goes where it comes again; a licence line stays."""
    from tidemark.llm.units import repeated_units

    passage = " ".join(f"Sentence number {k} holds seven plain words." for k in range(9))
    licence = "All rights of this text are with those who wrote it.\n"
    own = [licence + f"Opening {k} words of document {k} here. And so on {k} until {passage} It ends {k} with others {k}." for k in range(3)]
    out = {r["doc_id"]: (r["kept"], r["removed"]) for r in repeated_units(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    assert out[0] == (own[0], None)
    for k in (1, 2):
        inner = passage[passage.index("Sentence number 1") - 1 :]
        assert out[k][0] == own[k].replace(inner, "") and len(out[k][1]) == 1


# --- 6 ---------------------------------------------------------------------------------------------------------------------------------------


def test_mixing(docs, data):
    from tidemark.llm.mixing import mix, mix_report

    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target = set(names), {}
    budget = 1.5 * sum(sizes.values())
    while left:
        share = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > 2 * sizes[s]}
        for s in over or left:
            target[s] = 2.0 * sizes[s] if over else share * weight[s]
        left -= over or left
    report = mix_report(docs).collect()
    assert len(report) == len(data)
    taken = Counter()
    by_doc = {}
    for d, t, _, s in data:
        by_doc.setdefault((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), s)
    for r in report:
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        s = by_doc[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        taken[s] += r["taken"]
    assert sum(taken.values()) <= budget
    assert sets(mix_report(docs)) == sets(mix_report(docs.repartition(7)))
    m = mix(docs)
    assert m.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in m.collect()) == sum(taken.values())
    names = ["m_doc", "m_source", "m_size", "m_key", "m_copy", "rows", "r", "body", "copies", "at", "part", "f_size", "each", "chunk"]
    clash = docs.select("*", *(F.lit(i).alias(x) for i, x in enumerate(names)))
    assert mix(clash).columns == clash.columns and mix(clash).count() == m.count()


def test_mixing_deals_repeated_rows_apart(spark, monkeypatch):
    """A source of equal rows comes near its target too; small chunks, cells and buckets give the same."""
    from tidemark.llm import mixing

    rows = [(7, " ".join(["w"] * 12), "a")] * 500 + [(i, " ".join(["w"] * 60), s) for s in "bc" for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix_report(docs)
    for r in found.groupBy("target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 120
    words = {r["source_size"]: r["t"] for r in found.where("size = 12").groupBy("source_size").agg(F.sum("taken").alias("t")).collect()}
    assert mixing.mix(docs).where("source = 'a'").count() * 12 == words[6000]
    assert mixing.mix(docs).where("source <> 'a'").count() * 60 == found.where("size = 60").agg(F.sum("taken")).first()[0]
    one = sets(found)
    for name in ("CHUNK", "MAX_CUT_ROWS", "BUCKET_ROWS", "MAX_BROADCAST_SOURCES"):
        monkeypatch.setattr(mixing, name, 3)
    assert sets(mixing.mix_report(docs)) == one


def test_mixing_hits_targets(spark):
    from tidemark.llm.mixing import mix_report

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "hot" if i % 3 else f"s{i % 9}") for i in range(9000)]
    for r in mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 0.01 * r["target"] + 120


# --- 7 ---------------------------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    from tidemark.llm.chat import conversation_digests, format_conversations, parse_conversations

    nasty = ["<|im_end|><|im_start|>assistant ok", "\\e \\p \\n <| \\", "a\n\nb", "", None, "日本<|im_sep|>", "x" * 50_000, "<", "|im_end|>", "\n"]
    turns = [(1, i, ("user", "assistant", "assistant", "a\nb<|", None)[i % 5], nasty[i % len(nasty)]) for i in range(25)]
    turns += [(2, 0, "assistant", t) for t in nasty] + [(3, None, "user", None), (None, 1, None, "hi")]
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, turns int, formatted string")
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    formatted = format_conversations(df)
    back = {r["conv_id"]: r for r in parse_conversations(formatted).collect()}
    marked = {r["conv_id"]: r for r in formatted.collect()}
    for c, ts in by.items():
        ts = sorted(ts)
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in ts]
        assert list(back[c]["learned"]) == [x for _, r, x in ts if r == "assistant"]
        assert marked[c]["formatted"].count("<|im_start|>") == 1 + sum(a[1] != b[1] for a, b in zip(ts, ts[1:]))
    d = {r["conv_id"]: r for r in conversation_digests(df).collect()}
    for c, ts in by.items():
        ts = sorted(ts)
        assert d[c]["n_turns"] == len(ts)
        assert d[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert (d[c]["loss_chars"], d[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert conversation_digests(df.limit(0)).collect() == []


# --- 8 ---------------------------------------------------------------------------------------------------------------------------------------


def test_leaks(spark, docs):
    from tidemark.llm.leaks import Items, drop_leaks, edit_distance, find_leaks

    rng = np.random.default_rng(4)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(8, 60))))) for i in range(60)] + [(100, "too short to tell"), (101, None), (102, "")]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    planted, wanted = [], set()
    for j in range(150):
        i, t = items[int(rng.integers(0, 60))]
        w = t.split()
        for _ in range(len(w) // 10):
            w[int(rng.integers(0, len(w)))] = "edited"
        before, after = (" ".join(rng.choice(vocab, 30)) for _ in range(2))
        planted.append((1000 + j, before + ", " + " ".join(w).upper().replace(" V7", "\nV7") + "! " + after))
        wanted.add((1000 + j, i))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = find_leaks(both, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(got & wanted) / len(wanted) >= 0.9
    assert all(d >= 1000 for d, _ in got)  # nothing in clean documents
    blocks = {(r["doc_id"], r["item_id"]) for r in find_leaks(both, bench, block_chars=3000).collect()}
    assert blocks == got
    left = drop_leaks(both, bench)
    assert left.columns == both.columns and left.count() == both.count() - len({d for d, _ in got})
    assert find_leaks(both, bench.limit(0)).collect() == [] and find_leaks(both.limit(0), bench).collect() == []

    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(300):
        p, t = rng.integers(0, 4, int(rng.integers(1, 70))).tolist(), rng.integers(0, 4, int(rng.integers(0, 80))).tolist()
        peq = {}
        for k, w in enumerate(p):
            peq[w] = peq.get(w, 0) | 1 << k
        assert edit_distance(peq, len(p), t)[0] == slow(p, t)
    assert Items([], [], 0.8, 8).matches(pa.array(["a b c"])) == []


def test_short_items_are_found_word_for_word(spark):
    from tidemark.llm.leaks import drop_leaks, find_leaks

    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "yes"), (3, " ?"), (4, None), (5, "who wrote it"), (6, "one two three four five six seven eight nine ten")], "item_id long, text string")
    texts = ["Tell me: who WROTE\nit, and who wrote it again.", "who it wrote", "Oh yes", "yesterday", "who wrote", "", None, "so one two three four five six seven eight nine ten"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [tuple(r) for r in find_leaks(docs, bench).collect()]
    expect(found, [(0, 1, 2, 5, 3, 0), (0, 5, 2, 5, 3, 0), (2, 2, 1, 2, 1, 0), (7, 6, 1, 11, 10, 0)])
    expect([(r["doc_id"],) for r in drop_leaks(docs, bench).collect()], [(1,), (3,), (4,), (5,), (6,)])


# --- 9 ---------------------------------------------------------------------------------------------------------------------------------------


def kneser_ney(train, n=5):
    """Interpolated modified Kneser-Ney over bytes, straight from the definition."""
    counts = [None] * (n + 1)
    counts[n] = Counter(x[i : i + n] for t in train for x in [bytes(n - 1) + t] for i in range(len(t)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = [None] * (n + 1)
    for k in range(1, n + 1):
        c = Counter(counts[k].values())
        if c[1] and c[2] and c[3]:
            y = c[1] / (c[1] + 2 * c[2])
            disc[k] = [max(0.1, min(i, i - (i + 1) * y * c[i + 1] / c[i])) for i in (1, 2, 3)]
        else:
            disc[k] = [0.5, 1.0, 1.5]
    after = [defaultdict(list) for _ in range(n + 1)]
    for k in range(1, n + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]].append(c)

    def p(g):
        q = 1 / 256
        for k in range(1, n + 1):
            own = g[n - k :]
            follow = after[k].get(own[:-1])
            if follow:
                d = lambda c: disc[k][min(c, 3) - 1]
                c = counts[k].get(own, 0)
                q = (max(c - d(c), 0) if c else 0) / sum(follow) + sum(map(d, follow)) / sum(follow) * q
        return q

    return lambda t: [-np.log2(p((bytes(n - 1) + t)[i : i + n])) for i in range(len(t))]


def test_perplexity(spark, docs, data):
    from tidemark.llm.common import mix64
    from tidemark.llm.perplexity import PASSAGE, keep_good, quality_report

    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(2, 0, 0), (94, 0, 1), (95, None, None)], "doc_id long, quality int, toxic int")
    small = docs.where("doc_id < 94 or doc_id is null")
    found = quality_report(small, labels, quantile=0.9).collect()
    fold = lambda d: int(mix64(np.array([d or 0], np.uint64))[0] & np.uint64(1))
    trusted = set(range(40)) - {2}
    models = {}
    wanted = []
    for d, t, lang, _ in data:
        if d is not None and d >= 94:
            continue
        m = (1 - fold(d), lang or "")
        if m not in models:
            own = [x[1].encode() for x in data if x[0] in trusted and fold(x[0]) == m[0] and (x[2] or "") == m[1] and x[1]]
            models[m] = kneser_ney(own) if own else None
        bits = models[m](t.encode()) if t and models[m] else None
        worst = bits and max(sum(bits[i : i + PASSAGE]) for i in range(max(1, len(bits) - PASSAGE + 1))) / PASSAGE
        wanted.append((d, lang, 2 ** np.mean(bits) if bits else None, 2**worst if bits else None))
    got = [(r["doc_id"], r["lang"], r["perplexity"], r["worst"]) for r in found]
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key)):
        assert a[:2] == b[:2] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-5 * y) for x, y in zip(a[2:], b[2:])), (a, b)
    assert all(r["keep"] == (r["threshold"] is None or r["perplexity"] is None or (r["perplexity"] <= r["threshold"] and r["worst"] <= r["worst_threshold"])) for r in found)
    assert not all(r["keep"] for r in found)
    kept = keep_good(small, labels, 0.9)
    assert kept.columns == small.columns and sets(kept.select("doc_id")) == sorted(((r["doc_id"],) for r in found if r["keep"]), key=key)
    assert quality_report(small, labels.limit(0)).where("keep").count() == small.count()
    assert quality_report(small.limit(0), labels).collect() == []
    assert keep_good(small.limit(0), labels).collect() == []


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    """Texts over several slices and blocks of n-grams get the bits they get whole."""
    from tidemark.llm import perplexity
    from tidemark.llm.common import utf8_parts

    rng = np.random.default_rng(3)
    texts = ["", *("".join(rng.choice(list("abcdé \n"), n)) for n in (1, 3, 50, 700)), ""]
    data, offsets = utf8_parts(pa.array(texts))
    whole = perplexity.ngram_keys(data, offsets, 0, len(data))
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(perplexity, "SLICE", size)
        parts = [perplexity.ngram_keys(data, offsets, lo, hi) for lo, hi in perplexity.slices(len(data))]
        for k in range(3):
            assert (np.concatenate([p[k] for p in parts]) == whole[k]).all()
    for i, t in enumerate(texts):
        raw = bytes(4) + t.encode()
        assert [int.from_bytes(raw[j : j + 5], "big") for j in range(len(raw) - 4)] == whole[0][whole[1] == i].tolist()
    g = np.unique(rng.integers(0, 1 << 40, 1000, dtype=np.uint64))
    assert (perplexity.unpack(perplexity.pack(g), len(g)) == g).all()


def test_shards_do_not_change_scores(spark, docs, monkeypatch):
    from tidemark.llm import perplexity

    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    small = docs.where("doc_id < 94")
    close = lambda df: sorted(((r["doc_id"], r["keep"], round(r["perplexity"] or 0, 4), round(r["worst"] or 0, 3)) for r in df.collect()), key=key)
    one = close(perplexity.quality_report(small, labels, 0.9))
    monkeypatch.setattr(perplexity, "SHARD_GRAMS", 100)
    monkeypatch.setattr(perplexity, "MAX_BROADCAST_IDS", 0)
    assert close(perplexity.quality_report(small, labels, 0.9)) == one
    for name, value in (("BLOCK", 3000), ("SLICE_GRAMS", 60), ("TASK_GRAMS", 20000)):  # many blocks, whose questions to a shard meet several copies of it
        monkeypatch.setattr(perplexity, name, value)
    assert close(perplexity.quality_report(small, labels, 0.9)) == one
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the copies come by shuffles
    try:
        assert close(perplexity.quality_report(small, labels, 0.9)) == one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    twice = small.unionByName(small)  # blocks alike
    assert close(perplexity.quality_report(twice, labels, 0.9))[::2] == [r for r in close(perplexity.quality_report(twice, labels, 0.9))][1::2]


def test_length_bands_judge_long_documents_by_long_ones(spark):
    path = "/root/testdata/sf0.1"
    from tidemark.llm.perplexity import quality_report

    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    kind = F.expr("case when quality = 0 then 'junk' when toxic = 1 then 'toxic' else 'clean' end")
    r = quality_report(docs, labels).join(labels, "doc_id").groupBy(kind.alias("kind")).agg(F.avg((~F.col("keep")).cast("int")).alias("gone"))
    gone = {x["kind"]: x["gone"] for x in r.collect()}
    assert gone["junk"] >= 0.92 and gone["toxic"] >= 0.6 and gone["clean"] <= 0.02  # a few per cent of the labels are wrong


def test_rare_languages_are_judged(spark):
    from tidemark.llm.perplexity import keep_good, quality_report

    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(60)]
    prose = lambda: " ".join(rng.choice(vocab, 60))
    noise = lambda: "".join(chr(c) for c in rng.integers(33, 126, 360))
    rows = [(i, prose(), "en") for i in range(200)] + [(300 + i, prose(), "de") for i in range(5)]
    rows += [(400 + i, noise(), lang) for i, lang in enumerate(["de", "xx", None] * 4)] + [(500, prose(), "xx"), (501, prose(), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows if i < 304], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in keep_good(docs, labels).collect()}
    report = quality_report(docs, labels).collect()
    assert kept == {r["doc_id"] for r in report if r["keep"]}
    assert all(r["threshold"] is not None and r["perplexity"] is not None for r in report)
    assert not kept & set(range(400, 412)) and {500, 501} <= kept


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    from tidemark.llm.perplexity import quality_report

    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    r = quality_report(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    kept = {x["quality"]: x["kept"] for x in r.collect()}
    assert kept[1] >= 0.95 and kept[0] <= 0.35


# --- 10 --------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot,shard,length", [(5000, 1 << 21, 200), (4, 1000, 200), (5000, 1 << 21, 64)])
def test_suffix_dedup(docs, data, hot, shard, length):
    from tidemark.llm.suffixes import remove_repeats

    texts = [(d, (t or "").encode()) for d, t, *_ in data]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    wanted = []
    for d, b in texts:
        m = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        gone = np.cumsum(m)[: len(b)] > 0
        runs = int(((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0)
        wanted.append((d, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    found = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in remove_repeats(docs, length, hot, shard).collect()]
    expect(found, wanted)


def test_suffix_array():
    from tidemark.llm.suffixes import SuffixArray

    rng = np.random.default_rng(6)
    for data in (rng.integers(0, 3, 700), np.zeros(300), np.tile(rng.integers(0, 9, 50), 12)):
        data = data.astype(np.uint8)
        raw = data.tobytes()
        s = SuffixArray(data, 200)
        pads = [raw[i : i + 200].ljust(200, b"\0") for i in range(len(raw))]
        assert [pads[i] for i in s.sa] == sorted(pads)
        lcp = s.common_prefixes()
        for a, b in zip(s.sa[:-1].tolist(), s.sa[1:].tolist()):
            k = 0
            while k < 200 and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            assert min(lcp[b], len(raw) - a) >= min(k, 200) or lcp[b] == k


# --- all -------------------------------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, nothing, tmp_path):
    import public_tokenizers
    from tidemark.llm.lines import duplicate_lines
    from tidemark.llm.mixing import mix, mix_report
    from tidemark.llm.simhash import near_duplicates
    from tidemark.llm.suffixes import remove_repeats
    from tidemark.llm.token_ids import encode_documents
    from tidemark.llm.units import repeated_units

    for f in (duplicate_lines, mix, mix_report, near_duplicates, remove_repeats, repeated_units):
        assert f(nothing).collect() == [], f
    assert encode_documents(nothing, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "token_ids"]
    kept = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, kept, path)
        assert out.columns == docs.columns, name
        before, after = {r["doc_id"] for r in kept.collect()}, [r["doc_id"] for r in out.collect()]
        assert set(after) <= before and after
        kept = out
    assert corpus_pipeline.run(spark, path).count() == kept.count()
