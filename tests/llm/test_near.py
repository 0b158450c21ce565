"""The pipeline's near-dedup against brute force: planted copies, null and repeated ids."""

from __future__ import annotations

import random

import corpus_pipeline
from lanewise.llm import common, near
from tests.llm.test_dedup import DOCS, words


def likeness(a, b):
    return len(a & b) / len(a | b)


def grouped(texts):
    """Label of every text's component over pairs with Jaccard of at least 0.8 on five words."""
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    labels = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if labels[a] != labels[b] and likeness(sets[a], sets[b]) >= 0.8:
                low, high = sorted((labels[a], labels[b]))
                labels = [low if x == high else x for x in labels]
    return labels


def test_planted_copies(spark):
    rng = random.Random(11)
    line = words(rng, 12)
    texts = [f"{line} {words(rng, 20)}" for _ in range(60)]  # share a line, but are not alike
    for n in (150, 400, 800):
        for share in (0.0, 0.002, 0.005, 0.01, 0.02, 0.022, 0.03, 0.1):
            for _ in range(3):
                base = words(rng, n).split()
                edited = [words(rng, 1) + "x" if rng.random() < share else w for w in base]
                texts += [" ".join(base), " ".join(edited) + " end"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    labels = grouped(texts)
    expected = [k for k, x in enumerate(labels) if k == x]
    assert 40 < len(texts) - len(expected) < 72
    docs = spark.createDataFrame([(k, t, "en", 1, "f") for k, t in enumerate(texts)], DOCS)
    got = corpus_pipeline.near_first(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == expected


def test_chain_beyond_the_pivot(spark):
    """Copies that are alike in a chain, while the ends are not."""
    rng = random.Random(12)
    base = words(rng, 100).split()
    texts = [" ".join(base[: 100 - 12 * 0])] + [" ".join(base[12 * k :] + [f"n{j}" for j in range(12 * k)]) for k in range(1, 5)]
    rows = [(k, t, "en", 1, "f") for k, t in enumerate(texts)]
    kept = near.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == [k for k, x in enumerate(grouped(texts)) if k == x]


def test_null_and_repeated_ids(spark):
    """Through exact, near and passage dedup, each document's content stays once."""
    rng = random.Random(13)
    alone, twice, nulls, first, second, shared = (words(rng, 150) for _ in range(6))
    rows = [
        (None, alone), (1, twice), (1, twice), (1, twice.replace(" ", "\t", 1)), (None, nulls), (None, nulls), (None, nulls + " end"),
        (2, first), (2, second), (3, first + " end"), (4, second + " end"), (5, shared), (None, shared + " end"),
    ]
    docs = spark.createDataFrame([(i, t, "en", 1, "f") for i, t in rows], DOCS)
    for stage in (corpus_pipeline.first_copies, corpus_pipeline.near_first, corpus_pipeline.unrepeated):
        docs = stage(spark, docs, "")
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(str(i) for i, _ in got) == ["1", "2", "2", "5", "None", "None"]
    strip = lambda t: " ".join(t.split()).removesuffix(" end")
    assert sorted(strip(t) for _, t in got) == sorted([alone, twice, nulls, first, second, shared])


def tasks(spark, work):
    """Tasks that the stages of ``work`` ran."""
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("counted", "")
    try:
        result = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {i for job in tracker.getJobIdsForGroup("counted") for i in tracker.getJobInfo(job).stageIds}
    return sum(s.numCompletedTasks for i in stages if (s := tracker.getStageInfo(i))), result


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """Over many partitions a round of components costs few of their number: the driver remembers each task."""
    edges = spark.createDataFrame([(7 * i, 7 * i + j) for i in range(50) for j in range(1, 5)], "a long, b long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ran, found = tasks(spark, lambda: common.components(edges).collect())
        monkeypatch.setattr(common, "FEW", 0)  # edges that are shuffled give the same
        assert sorted(found) == sorted(common.components(edges).collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r.node: r.root for r in found} == {7 * i + j: 7 * i for i in range(50) for j in range(5)}
    assert 100 < ran < 800
    done, n = common.short(spark.range(100).repartition(64))
    assert n == 100 and done.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
