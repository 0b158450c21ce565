"""Exact, near and passage deduplication against brute force on planted rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lanewise.llm import exact_dedup, repeats, simhash
from lanewise.llm.common import components
from lanewise.llm.suffixes import repeated_windows, suffix_array

DOCS = "doc_id long, text string, lang string, kept int, Fp string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))


def corpus(seed=0):
    rng = random.Random(seed)
    base = words(rng, 120)
    rows = [(1, base), (2, base.replace(" ", "\t\n", 1)), (3, None), (4, ""), (5, " "), (6, "one"), (6, "one"), (None, "one"), (7, base + " tail"), (8, base.upper())]
    rows += [(100 + i, words(rng, rng.randint(0, 60))) for i in range(20)]
    for i in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "edit"
        rows.append((200 + i, words(rng, 5) + " " + " ".join(w)))
    rows.append((300, "é" * 300 + base + "漢" * 200))
    rows.append((301, "x" * 1500))
    return [(i, t, "en", 9, "clash") for i, t in rows]


def test_exact(spark):
    rows = corpus()
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "Fp", "keep_id", "group_size", "kept", "text_sha256"]
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in rows]
    ids = collections.defaultdict(list)
    for (i, *_), n in zip(rows, norm, strict=True):
        ids[n].append(i)
    low = {n: min((i for i in v if i is not None), default=None) for n, v in ids.items()}
    expected = sorted((str(i), str(low[n]), len(ids[n]), i == low[n], hashlib.sha256(n.encode()).hexdigest()) for (i, *_), n in zip(rows, norm, strict=True))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got.collect()) == expected
    full = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), max_bits=64)  # a full bitmap
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in full.collect()) == expected
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def brute_simhash(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, ids, radius):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for k in range(len(fps)):
        groups[top(k)].append(ids[k])
    low = {g: min(v) for g, v in groups.items()}
    return [low[top(k)] for k in range(len(fps))]


@pytest.mark.parametrize("radius", [2, 6])
def test_near(spark, radius):
    rows = [r for r in corpus(1) if r[0] is not None]
    fps, ids = [brute_simhash(r[1]) for r in rows], [r[0] for r in rows]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), radius=radius, parts=4)
    expected = sorted((i, f, c) for i, f, c in zip(ids, fps, linked(fps, ids, radius), strict=True))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()) == expected
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_tiles_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "GUESTS", 11)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)})
    points = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    roots = {r.node: r.root for r in components(simhash.links(points)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == linked(fps, list(range(len(fps))), 2)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 150), (150, 120), (7, 7)] + [(200, 200 + rng.randint(1, 50)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[120] == got[100] == 100 and all(got[b] == 200 for a, b in edges if a == 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        text = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def counted(texts, width):
    seen = collections.Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    return [[k + width <= len(t) and seen[t[k : k + width]] > 1 for k in range(len(t))] for t in texts]


def test_repeated_windows():
    rng = random.Random(5)
    for _ in range(60):
        signs = rng.choice([b"ab", bytes(range(256)), b"a", b"abcdefgh "])
        base = bytes(rng.choices(signs, k=rng.randint(50, 300)))
        texts = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(len(base))
            texts.append(bytes(rng.choices(signs, k=rng.randint(0, 30))) + base[a : rng.randint(a, len(base))] + bytes(rng.choices(signs, k=rng.randint(0, 30))))
        width = rng.choice([16, 40])
        assert repeated_windows(texts, width).tolist() == [f for flags in counted(texts, width) for f in flags]


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_passages(spark, crowd):
    rows = corpus(2)
    texts = [(t or "").encode() for _, t, *_ in rows]
    flags = counted(texts, 400)
    expected = []
    for (i, *_), t, f in zip(rows, texts, flags, strict=True):
        gone = bytearray(len(t))
        for k in np.flatnonzero(f):
            gone[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        expected.append((str(i), len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])), kept))
    got = repeats.remove(spark.createDataFrame(rows, DOCS), crowd=crowd)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == sorted(expected)
    assert sum(e[2] for e in expected) > 5000
    assert repeats.remove(spark.createDataFrame([], DOCS)).count() == 0


def test_spans_of_a_frequent_anchor_stay_dealt(spark, monkeypatch):
    rng = random.Random(4)
    line = words(rng, 150)
    rows = [(i, words(rng, 40) + " " + line + " " + words(rng, 40), "en", 1, None) for i in range(40)]
    rows += [(100 + i, words(rng, 300), "en", 1, None) for i in range(5)] * 2
    docs = repeats._keyed(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    spans = repeats.saved(repeats.runs(docs, repeats.WINDOW, repeats.KGRAM, repeats._as_is)).dropDuplicates(repeats.SPAN).cache()
    want = collections.Counter(r.h for r in spans.select("h").collect())
    h, most = want.most_common(1)[0]
    assert most > 30
    spread = spans.repartition(6, "digest")
    for often in (1, 5, most):
        monkeypatch.setattr(repeats, "OFTEN", often)
        told = repeats._with_kinds(spread)
        assert sorted((r.h, r.left, r.digest, r.kinds) for r in told.collect()) == sorted((r.h, r.left, r.digest, want[r.h]) for r in spans.collect() if want[r.h] > 1)
        dealt = told.where(told.h == h).groupBy(repeats.F.spark_partition_id()).count().collect()
        assert often == most or max(r["count"] for r in dealt) < most / 2
    monkeypatch.setattr(repeats, "OFTEN", 5)
    frequent = {r.doc_id: r.kept for r in repeats.remove(spark.createDataFrame(rows, DOCS)).collect()}
    monkeypatch.setattr(repeats, "MOST", 0)
    assert frequent == {r.doc_id: r.kept for r in repeats.remove(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(line.encode()[20:-20] not in frequent[i] for i in range(40))


def test_passages_by_words(spark):
    rng = random.Random(12)
    shared, short = words(rng, 55), " ".join(["of"] * 4 + words(rng, 46).split())
    rows = [(i, f"{words(rng, rng.randint(0, 30))} {shared if i % 3 else words(rng, 80)}\n{words(rng, 20)} {short if i % 2 else ''}") for i in range(24)]
    rows += [(50, None), (51, ""), (52, words(rng, 48)), (53, "é" + shared), (None, shared[::-1]), (54, "\t".join(shared.split()))]
    rows += [(55, "la " * 400), (52, "two rows of one id")]
    seen = collections.Counter(tuple(w[k : k + 49]) for _, t in rows for w in [(t or "").split()] for k in range(len(w) - 48))
    expected = []
    for i, t in rows:
        body, spots = t or "", [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        w, gone = [body[a:b] for a, b in spots], set()
        for k in range(len(w) - 48):
            if seen[tuple(w[k : k + 49])] > 1:
                gone |= set(range(spots[k][0], spots[k + 48][1]))
        expected.append((str(i), "".join(c for k, c in enumerate(body) if k not in gone)))
    given = spark.createDataFrame([(i, t, "en", 9, "clash") for i, t in rows], DOCS)
    for crowd in (repeats.CROWD, 1):
        got = repeats.remove_passages(given, crowd=crowd)
        assert sorted((str(r.doc_id), bytes(r.kept).decode()) for r in got.collect()) == sorted(expected)
    assert sum(len(t or "") for _, t in rows) > 2 * sum(len(t) for _, t in expected)
    assert repeats.remove_passages(given.limit(0)).count() == 0
