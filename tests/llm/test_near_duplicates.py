"""Operators 2, 7 and 10 and the kept documents, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.llm import jaccard, vectors
from corbel.llm.jaccard import jaccard_components, keep_representatives
from corbel.llm.vectors import near_vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def union_find(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, width=5, percent=75):
    def grams(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union_find(ids, links).items()}


def corpus(seed, groups, size, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.15:
                text += passage
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "groups", "size"), [(1, 30, 5), (2, 2, 90), (3, 120, 1)])
def test_components_match_all_pairs(spark, seed, groups, size):
    rows = corpus(seed, groups, size)
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \t\n", "one two", "One  TWO", "a b c d e", "a b c d e f"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize(("hot", "rows_sent", "block"), [(1, 0, 50), (3, 100_000, 40_000)])
def test_components_with_hot_shingles(spark, monkeypatch, hot, rows_sent, block):
    """Nearly every shared 5-gram is salted, so most of its groups have one class; without broadcasts, in small blocks."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", rows_sent)
    monkeypatch.setattr(jaccard, "WANTED_ROWS", rows_sent)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block)
    rows = corpus(4, 60, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()} == brute(rows)


@pytest.mark.parametrize("local", [3, 200_000])
def test_connected_components(spark, monkeypatch, local):
    from corbel.llm import components
    from corbel.workspace import Workspace

    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(local)
    for kind, of in (("long", int), ("binary", lambda x: x.to_bytes(2, "big"))):
        edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
        df = spark.createDataFrame([(of(a), of(b)) for a, b in edges] + [(None, of(1))], f"a {kind}, b {kind}").repartition(5)
        got = {(int(r.node) if kind == "long" else int.from_bytes(r.node, "big")): (int(r.root) if kind == "long" else int.from_bytes(r.root, "big")) for r in components.connected_components(df, Workspace(spark, "cc")).collect()}
        want = union_find({x for e in edges for x in e}, edges)
        assert got == {k: v for k, v in want.items() if any(k in e for e in edges if e[0] != e[1])}


def test_edges_of_jaccard(spark):
    """Exactly three quarters links; repeated rows, null ids, long texts, clashing columns."""
    base = [f"x{k}" for k in range(25)]  # 21 shingles
    a, b = " ".join(base), " ".join([*base[:-3], "y", "y", "y"])  # 18 shared of 24
    rows = [(1, a, "n"), (2, b, "n"), (2, b, "n"), (None, a, "n"), (9, "z " * 50_000, "n"), (8, "z " * 49_999 + "z", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string").withColumn("n_shingles", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(0, 21, 1), (1, 21, 1), (2, 21, 1), (2, 21, 1), (8, 1, 8), (9, 1, 8)]
    assert jaccard_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("sent", [0, 100_000])
def test_representatives(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", sent)
    rows = corpus(5, 10, 4)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(None, "alone", "en", "s", 5), (0, rows[0][1], "en", "s", 1)], SCHEMA)
    got = keep_representatives(df.withColumn("stays", F.lit(1)).withColumn("component_id", F.lit(2))).collect()
    kept = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert len(got) == len(kept) + 1 and kept == sorted({c for _, c in brute(rows).values()})


@pytest.mark.parametrize(("dims", "tile"), [(1, 1024), (3, 1024), (16, 1024), (17, 4), (20, 1024), (25, 8)])
def test_vectors_match_all_pairs(spark, dims, tile, monkeypatch):
    """A last block of one dimension too; with small tiles the cells have more coordinates."""
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(40, dims))
    vecs = [*(b + rng.normal(size=dims) * s for b in base for s in (0.0, 0.05, 0.15, 0.3)), base[0] * 3, base[0] * 1.0, np.zeros(dims), np.full(dims, np.nan), np.full(dims, 1e300), np.full(dims, 1e-300)]
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(vecs)] + [(900, None, 1), (901, [], 1), (902, [None] * dims, 1), (903, [1.0] * (dims + 1), 1)]
    ok = {k: np.array(v) / np.abs(v).max() for k, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in ok.items()}
    ids = sorted(unit)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    comp = union_find([r[0] for r in rows], links)
    n = {k: sum(k in x for x in links) for k in comp}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (n[k], c, c == k) for k, c in comp.items()}


def test_vectors_empty_and_repeated(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()) == [(0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    assert near_vectors(df.limit(0)).collect() == []


def test_tiles_meet_once_without_a_shuffle(spark):
    """Vectors are not sent to where they are compared: tasks read the tiles from where they lie."""
    tiles = spark.range(0, 60, 1, 5).select((F.col("id") + F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("tile"), (F.col("id") % 2).cast("int").alias("dims"), F.array(F.lit(b"k")).alias("key"), F.array(F.lit(1)).alias("copies"), F.lit(b"v").alias("vec"))
    met = vectors._pairs(tiles.withColumn("vec", F.concat(F.lit(b"v"), F.col("tile").cast("string").cast("binary"))))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    pairs = [tuple(sorted((bytes(r.l_vec), bytes(r.r_vec)))) for r in met.collect()]
    assert len(pairs) == len(set(pairs)) == 2 * 30 * 31 // 2
