"""Least-squares packing, source divergence and centroid clustering against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lanewise.llm import centroids, divergence, windows

DOCS = "doc_id long, text string, lang string, source string, n long, VALUE string, Row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 7, "x", 1) for i, t, lang, source in rows], DOCS)


def is_power(n):
    return n & (n - 1) == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram(seed):
    rng = random.Random(seed)
    sizes = [700] * 5000 if seed == 0 else [rng.randint(1, 63) for _ in range(rng.choice([3, 400, 20_000]))] + [64] * rng.randint(0, 4)
    capacity = 1024 if seed == 0 else 64
    made = windows.plan(dict(collections.Counter(sizes)), capacity)
    held = collections.Counter()
    for pattern, n in made.patterns:
        assert sum(pattern) == capacity and n > 0
        held.update({s: pattern.count(s) * n for s in set(pattern)})
    assert held + collections.Counter(made.loose) == collections.Counter(sizes)
    if len(sizes) > 10_000:
        assert sum(made.loose.values()) < len(sizes) / 50  # long ones in excess of what can join them


def test_least_squares_meets_a_histogram_that_combinations_fill():
    rng = np.random.default_rng(3)
    counts = np.zeros(33, np.int64)
    for a, b in [(20, 12), (8, 8), (24, 8), (31, 1), (16, 16)]:
        times = int(rng.integers(50, 500))
        for s in (a, b) if a + b == 32 else (a, b, 16):
            counts[s] += times
    combos = windows.combinations(counts, 32)
    x = windows.solve(combos, counts, 3000)
    held = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=33)
    assert (x >= 0).all() and np.abs(held - counts)[1:].max() < 2


def test_chunk_ids():
    from tokenizers import Tokenizer

    path = windows.default_tokenizer()
    plain, chunks = Tokenizer.from_file(path), windows.ChunkIds(path)
    rng = random.Random(5)
    parts = ["a", "word.", "Éa", "ñandú!", " ", "  ", "\n", "\t", " ", "　", "'s", "don't", "12", "x1", "漢字", "🙂", "<|endoftext|>", "ı", "ß,", "...", "É"]
    texts = ["", " ", "  ", " a", "a ", "a  ", "\n a", "a \n b", "a\n \nb", "a   b", "\x1c \x1c"] + ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n", "\n\n"]) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    for t, ids in zip(texts, chunks.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunk_ids_tokenise_each_word_once_whatever_follows_it(monkeypatch):
    from tokenizers import Tokenizer

    path = windows.default_tokenizer()
    plain, chunks, asked = Tokenizer.from_file(path), windows.ChunkIds(path), []
    encode = chunks._encode
    monkeypatch.setattr(chunks, "_encode", lambda texts: asked.extend(texts) or encode(texts))
    words = ["tree", "Haus", "été", "ñandú"]
    texts = [" ".join(w + tail for w in words) for tail in ("", "%%%", "***", ".)", "?!", "---", '."', "_")]
    for _ in range(2):
        for t, ids in zip(texts, chunks.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert sorted(asked) == sorted(["", "%%%", "***", ".)", "?!", "---", '."', "_"])  # the words go to the model

    odd = ["a'", "a's.", "a.'s", "×.", "a×.", "Ā.", "ɐ.", "漢.", "a…", "a….", "1.", "a1.", ".", "..a", "ª.", "µ!", "'", "'.", "-a-", "a\0.", "é́.", "ŉ.", "ǅ?"]
    texts = [lead + w + end for lead in ("", " ", "\n", "\n\n", "b ", "b\n", "b\t", "\t") for w in odd for end in ("", " ", "\n", " c.", "\nc.", "\tc.")]
    for t, ids in zip(texts, chunks.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunk_ids_forget_parts_and_ids_stay(monkeypatch):
    monkeypatch.setattr(windows, "PARTS", 3)
    chunks = windows.ChunkIds(windows.default_tokenizer())
    texts = ["tree Haus, x1", "Haus tree. ñandú!", "", "x1 tree\ttree"]
    first = [chunks.ids([t])[0] for t in texts]
    assert [chunks.ids([t])[0] for t in texts] == first == windows.ChunkIds(windows.default_tokenizer()).ids(texts)
    chunks.ids(["x" * 1000 + " " + "漢" * 1000])
    assert max(map(len, chunks.new)) <= windows.LONGEST


def test_uneven_white_space_is_what_the_pattern_says():
    pattern = re.compile(r"[^\S \n]| \s|\n\n\n|\n\n |\n[\n ]\Z")
    rng = random.Random(5)
    texts = ["", " ", "\n", *(f"a{chr(c)}b" for c in range(0x3100)), *("".join(rng.choices("a  \n\n\t\u3000", weights=[9, 2, 2, 2, 2, 0.1, 0.1], k=rng.randint(1, 8))) for _ in range(20_000))]
    assert [windows.ChunkIds.uneven(t) for t in texts] == [bool(pattern.search(t)) for t in texts]


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [None, "", "a", "a", "word " * 5000, "x" * 9000, "<|endoftext|> b"] + [" ".join(rng.choices(["tree", "Haus,", "über", "12", "x"], k=rng.randint(0, 1500))) for _ in range(60)] + ["same text again " * 230] * 40
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "another a", None, None), (None, "no id", None, None)]
    plain = Tokenizer.from_file(windows.default_tokenizer())
    got = windows.pack(docs(spark, rows)).collect()
    ids = collections.defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    spans = collections.defaultdict(list)
    for r in got:
        mine = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert mine
        if len(ids[r.doc_id]) == 1:
            spans[r.doc_id].append((r.start, r.length))
    for i, parts in spans.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i][0])
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and is_power(at)
    assert sum(1 for p in sequences.values() if sum(n for _, n in p) < 1024) <= 10
    assert windows.pack(docs(spark, [])).count() == 0
    assert [(r.length, r.offset) for r in windows.pack(docs(spark, [(1, None, None, None)])).collect()] == [(1, 0)]


def brute_audit(rows):
    found = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        mine = [x for x in found if x[0] == lang]
        df = collections.Counter(t for _, _, terms in mine for t in set(terms))
        kept = {t for t, n in df.items() if n >= 3}
        counts = {s: collections.Counter() for _, s, _ in mine}
        for _, s, terms in mine:
            counts[s].update(t for t in terms if t in kept)
        every = sum(counts.values(), collections.Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = sorted((-sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), b.encode()) for b, o in counts.items() if b != s)
            terms = sorted((-((p(c, t) - p(every, t)) ** 2 // p(every, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(every, t))
            out += [(lang, s, "pair", b.decode(), -v, k) for k, (v, b) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:200], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [divergence.CELLS, 64])
def test_divergence(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rng = random.Random(4)
    vocabulary = ["Tree", "tree", "é", "É", "漢字", "￿", "🙂", "ab", "x_y", "don't", " "] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 80))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "Ä", "z🙂", "z￿", None, "a", "a"])) for i in range(150)]
    rows += [(1, None, "en", "empty"), (None, "lone words only here", "xx", "one"), (None, "123 456", "xx", "two"), (5, "long " * 30_000, "en", "a"), (5, "long " * 30_000, "en", "a")]
    got = divergence.audit(docs(spark, rows)).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute_audit(rows)
    assert ("xx", "one", "pair", "two", 0, 1) in {tuple(r) for r in got}
    assert divergence.audit(docs(spark, [])).count() == 0


def test_shares_do_not_overflow():
    counts, total = [0, 5, 10**15 - 1, 7 * 10**14], 10**15
    assert divergence.shares(np.array(counts), np.array(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def brute_clusters(rows, k, dims, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    centres = [q for _, q in first]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(centres)]
    return sorted((str(i), near(q)[1], near(q)[0]) for i, q in kept), centres


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0])  # the smallest has few different vectors: ties and equal centroids
def test_clusters(spark, scale):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 1.0]) * rng.random() * scale for _ in range(4)]) for i in range(250)]
    rows += [(i, list(rows[3][1])) for i in range(300, 360)] + [(7, [0.0] * 4), (7, [0.0] * 4), (None, [0.5] * 4), (400, None), (401, []), (402, [1.0] * 3), (403, [None, 0.0, 0.0, 0.0]), (404, [float("nan")] * 4), (405, [float("-inf")] * 4)]
    given = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<float>, cluster int, Q string").repartition(3)
    as_floats = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (9, 1000):
        done, centres = centroids.cluster(given, k=k, dims=4)
        expected, expected_centres = brute_clusters(as_floats, k, 4, 5)
        assert centres.tolist() == expected_centres
        assert sorted((str(r.id), r.cluster, r.distance) for r in done.collect()) == expected
    assert centroids.cluster(given.limit(0), dims=4)[0].count() == 0
    assert centroids.cluster(given.where("embedding IS NULL"), dims=4)[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), dims=4)


def test_bounds_skip_distances_and_change_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (12, 8))
    x = (centres[rng.integers(0, 12, 2000)] + rng.integers(-40, 40, (2000, 8))).astype(np.int64)
    first = centroids.Round(centres)
    a, upper, lower = first.assign(x, *first.fresh(x))
    later = centroids.Round(centres + 1, centres)
    b, _, _ = later.assign(x, a, upper, lower)
    for c, got in ((centres, a), (centres + 1, b)):
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (exact.argmin(axis=1) == got).all()
    assert later.calculated < len(x) and first.calculated < 12 * len(x)
