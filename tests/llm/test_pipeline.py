"""The whole pipeline against a brute-force version of each stage; the SQL of op2 and op6."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lanewise.llm import entry, packing

SF = "/root/testdata/sf0.001"


def sample():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 8)))
    passage = " ".join(word() for _ in range(110))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "short text"), (5, "short \t text"), (6, "é " + passage)]
    for i in range(30):
        text = " ".join(word() for _ in range(rng.randint(5, 150)))
        rows.append((10 + i, text if i % 3 else f"{text} {passage} {word()}é"))
    other = " ".join(word() for _ in range(49))
    rows += [(50, f"{word()} {other}\n{passage} tail"), (51, f"{passage}\t\t{other}"), (52, f"head {other} x"), (53, f"{passage} {other}")]  # two that touch; two left without a word
    rows += [(100, rows[8][1]), (101, rows[9][1] + " x"), (102, rows[9][1].upper()), (103, "a " + rows[10][1] + " b c")]
    return [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in rows]


def five_words(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute(rows):
    docs = [(i, t or "") for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for i, t in sorted(docs):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), (i, t))
    docs = sorted(first.values())
    sets, low = [five_words(t) for _, t in docs], list(range(len(docs)))
    for _ in docs:  # until no link moves a label any more
        for a, b in itertools.combinations(range(len(docs)), 2):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low[a] = low[b] = min(low[a], low[b])
    docs = [d for k, d in enumerate(docs) if low[k] == k]
    seen = collections.Counter(tuple(w[k : k + 49]) for _, t in docs for w in [t.split()] for k in range(len(w) - 48))
    kept = []
    for i, t in docs:
        spots, gone = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", t)], bytearray(len(t))
        for k in range(len(spots) - 48):
            if seen[tuple(t[a:b] for a, b in spots[k : k + 49])] > 1:
                a, b = spots[k][0], spots[k + 48][1]
                gone[a:b] = b"\1" * (b - a)
        left = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        if left == t or left.split():
            kept.append((i, left))
    return kept


def test_pipeline(spark, tmp_path):
    rows = sample()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    expected = {}
    kept = brute(rows)
    assert 0 < sum(len(t) for _, t in kept) < 0.9 * sum(len(t or "") for _, t, *_ in rows)
    for i, t in kept:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for n, a in enumerate(range(0, len(ids), 2048)):
            expected[i, n] = a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected
    total = sum(n for _, n, _ in expected.values())
    assert len({r.sequence_id for r in got}) == -(-total // 2048)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(sample()[:12], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entry.ORACLES.items():
        found, expected = entry.QUERIES[name](spark, SF), duck.sql(sql)
        columns = sorted(found.columns)
        at = [expected.columns.index(c) for c in columns]
        assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(str(r[i]) for i in at) for r in expected.fetchall())
