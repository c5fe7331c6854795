"""Exact deduplication, filter interactions and source divergence against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from corbel.llm import divergence, exact, interactions

DOCS = "doc_id long, text string, lang string, source string, kept string, digest int"


def make_docs(seed, n=120):
    rng = random.Random(seed)
    base = ["Ein Wort und noch EIN wort", "plain words here", "", " \t ", "a  b c", "ab c", "naïve Ünïcode ÜBER alles", "x" * 300, "two $ signs & more", None, "SHOUT LOUD", " ".join(f"w{i % 97}" for i in range(260)), "same same " * 130]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        if t is not None and rng.random() < 0.4:
            t = t.replace(" ", rng.choice(["  ", "\n", "\x0b", " "]))
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""]), "x", i))
    return rows


def brute_exact(rows):
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0], k))
    out = []
    for text, group in groups.items():
        group.sort(key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
        for _, _, doc, k in group:
            out.append((doc, group[0][2], len(group), k == group[0][3], hashlib.sha256(text.encode()).hexdigest()))
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("counters", [4096, 8])  # with 8 counters hardly a text is frequent
def test_exact_brute_force(spark, monkeypatch, counters):
    monkeypatch.setattr(exact, "COUNTERS", counters)
    monkeypatch.setattr(exact, "WINNERS", min(exact.WINNERS, counters))
    rows = make_docs(1) + [(500, "hot page", "en", "s1", "x", 0)] + [(501 + i, "hot  page", "en", "s1", "x", 0) for i in range(60)]
    got = [tuple(r) for r in exact.exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert _sorted(got) == _sorted(brute_exact(rows))
    left = exact.drop_exact_duplicates(spark.createDataFrame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "lang", "source", "kept", "digest"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in got if r[3])


def test_exact_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b", "en", "s", "x", 0)] * 3 + [(2, "a b", "en", "s", "x", 0), (None, "ab", "en", "s", "x", 0), (None, None, None, None, None, None), (None, "", None, None, None, None)]
    got = exact.exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.kept for r in got) == 2 and {(r.keep_id, r.group_size) for r in got} == {(1, 5), (None, 2)}
    assert sorted((r.doc_id, r.text) for r in exact.drop_exact_duplicates(spark.createDataFrame([r for r in rows if r[0]], DOCS)).collect()) == [(1, "a b")]
    assert not exact.exact_duplicates(spark.createDataFrame([], DOCS)).collect()


def test_frequent_digests_are_found(spark):
    """A third of the rows is one text, and another one is just above the share that the summary promises."""
    n = 30_000
    share = int(n * 3.5 / exact.COUNTERS) + 2
    text = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 AND id < {} THEN 'warm' ELSE concat('t', id) END".format(3 * share)
    digests = spark.range(n).repartition(16).selectExpr(f"unhex(sha2({text}, 256)) AS digest")
    want = spark.sql("SELECT xxhash64(unhex(sha2('hot', 256))) AS a, xxhash64(unhex(sha2('warm', 256))) AS b").first()
    codes = {r.code for r in exact.frequent(digests).collect()}
    assert {want.a, want.b} <= codes and len(codes) <= exact.WINNERS


def test_exact_plan_has_no_python(spark):
    plan = exact.exact_duplicates(spark.createDataFrame(make_docs(2), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- filters -----------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    quality, toxic = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    docs = []
    for r in rows:
        t = r[1] or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {c for c, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), r[0] is not None and r[0] > least[t]), strict=True) if bad}
        docs.append((r[3] or "", fails, r[0] in quality, r[0] in toxic))
    out = []
    for part in {d[0] for d in docs}:
        here, shapley, steps = [d for d in docs if d[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = here
            for k, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), k, len(left), len(gone), sum(f in d[1] for d in here) - len(gone), sum(d[1] == {f} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return out


def test_audit_brute_force(spark):
    rows = make_docs(3) + [(7, "plain words here", "en", "s1", "x", 0)] * 2 + [(None, "plain words here", "en", "s2", "x", 0)] * 2
    rows += [(900, "fine words " * 3, "en", "s1", "x", 0)] * 2 + [(900, "fine words " * 3, "en", "s2", "x", 0)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(3, None, 1), (3, 0, None), (None, 1, 1), (900, 1, 0)]
    got = interactions.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert _sorted(map(tuple, got)) == _sorted(brute_audit(rows, labels))


def test_audit_empty_and_own_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not interactions.audit_filters(spark.createDataFrame([], DOCS), labels).collect()
    docs = spark.createDataFrame([(1, "a", "en", "s", "x", 0), (2, "a", "en", "s", "y", 1), (3, "b", "en", "s", None, 2)], DOCS)
    got = interactions.audit_filters(docs, labels, {"K": docs.kept == "y"}, "U").collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in got} == {("KU", 1, 2, 1, 0, 1), ("KU", 2, 2, 0, 1, 1), ("UK", 1, 2, 1, 0, 1), ("UK", 2, 2, 0, 1, 1)}


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in interactions.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


# --- divergence --------------------------------------------------------------------------------------------------


def brute_divergence(rows, min_docs, top=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(fold))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in here for t in set(d[2])).items() if n >= min_docs]
        count = {s: Counter() for s in {d[1] for d in here}}
        for d in here:
            count[d[1]].update(t for t in d[2] if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = share(sum(count.values(), Counter()))
        p = {s: share(c) for s, c in count.items()}
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if count[s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, k) for k, (v, t) in enumerate(found[:most], 1)]
    return out


def words(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "Straße", "ÉCOLE", "x1y", "z", "日本", "delta", "eps-ilon", "Rare"]
    some = lambda: " ".join(rng.choices(vocabulary, [9, 8, 7, 3, 3, 2, 2, 2, 1, 1, 0.1], k=rng.randrange(0, 30)))
    return [(i, rng.choice([some(), some(), "", None, "12 34"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None]), "k", 1) for i in range(n)] + [(i, "lonely", "fr", "a", "k", 1) for i in range(3)] + [(9, "9", "it", s, "k", 1) for s in "ab"]


@pytest.mark.parametrize(("tile", "block"), [(256, 1 << 20), (2, 7)])
def test_divergence_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", block)
    rows = words(4)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(r) for r in divergence.source_divergence(docs, min_docs=4, top=3).collect()]
    assert _sorted(got) == _sorted(brute_divergence(rows, 4, 3))
    assert not divergence.source_divergence(spark.createDataFrame([], DOCS)).collect()


def test_slices_are_told_apart_by_their_bytes():
    buf = np.frombuffer(b"ab ba ab ab abc ba c", np.uint8)
    starts, ends = divergence.boundaries(buf, np.array([0, 9, len(buf)]))
    for digest in (lambda x: 1, lambda x: len(x), divergence.xxhash.xxh3_64_intdigest):
        first, group = divergence.group_slices(buf, starts, ends, digest)
        of = [bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)]
        assert [of[first[g]] for g in group] == of and len(set(group)) == 4 == len(first)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("alpha beta gamma " * 50 + "x" * 900 + " end").encode()
    monkeypatch.setattr(divergence, "TEXT_BYTES", 64)
    assert divergence._long_row(np.frombuffer(text, np.uint8)) == Counter(text.split())
