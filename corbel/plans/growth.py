"""Boosted trees grown by leaves: the leaf with the greatest gain is split next, with L1 and L2 terms and least weights.

Features are cut into bins once, and rows are kept as one byte a feature, packed in blocks: a tree passes over all rows about ten times,
and a row on its own costs more to hand to a worker than to count.  Workers add up gradients by (leaf, feature, bin) over
their rows; only these sums are shuffled and reach the driver, whose queue of leaves chooses the splits.  Of two siblings the
smaller is counted and the other is its parent less it; gradients are whole numbers of a small unit, so sums are exact in
any order and a repeated task changes nothing.  One job counts for as many waiting leaves as may still be split, so a tree
takes about as many jobs as it is deep.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.functions.expressions import number
from corbel.operators.scaling import LogitScale
from corbel.operators.stage import Estimator
from corbel.plans.trees import Node, TreeModel, coded
from corbel.workspace import Workspace

#: Codes of a feature: 0 is missing, 1 to BINS are bins.
BINS = 255
#: Gradients are whole multiples of the greatest weight over this; sums of 2^33 rows stay exact.
UNITS = 1 << 30
#: Trees after which the validation table tells whether to go on.
WRITE_EVERY = 8
#: Accuracy of the quantiles that bound bins.
ACCURACY = 10_000

#: A row is a block of rows, each column their numbers as bytes.
BINNED = "row binary, y binary, w binary, codes binary, margin binary"
KINDS = {"row": np.int64, "y": np.uint8, "w": np.float64, "codes": np.uint8, "margin": np.float64}
SUMS = "slot int, feature int, bin int, n long, g long, h long"


@dataclass
class Grown:
    """A tree while it grows, by node: feature, which codes go left, children; leaves have no children."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    lefts: list[np.ndarray | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    ordered: list[bool] = field(default_factory=list)

    def add(self, count: int, value: float = 0.0) -> int:
        for name, x in zip(("feature", "cut", "lefts", "left", "right", "value", "gain", "count", "ordered"), (-1, 0, None, -1, -1, value, 0.0, count, True), strict=True):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def arrays(self) -> tuple:
        none = np.zeros(BINS + 1, bool)
        return np.array(self.feature), np.stack([none if x is None else x for x in self.lefts]), np.array(self.left), np.array(self.right), np.array(self.value)


def place(tree: tuple, codes: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, lefts, left, right, _ = tree
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while len(rows):
        rows = rows[left[at[rows]] >= 0]
        k = at[rows]
        at[rows] = np.where(lefts[k, codes[rows, feature[k]]], left[k], right[k])
    return at


@dataclass(frozen=True)
class Block:
    """Rows of the binned table."""

    row: np.ndarray
    y: np.ndarray
    w: np.ndarray
    codes: np.ndarray
    margin: np.ndarray

    def packed(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(getattr(self, c), kind).tobytes()], pa.binary()) for c, kind in KINDS.items()], names=list(KINDS))

    def after(self, trees: list[tuple]) -> np.ndarray:
        """Margins with those of ``trees`` added."""
        m = self.margin.copy()
        for t in trees:
            m += t[4][place(t, self.codes)]
        return m


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Block]:
    for batch in batches:
        for r in range(batch.num_rows):
            block = Block(**{c: np.frombuffer(batch.column(c)[r].as_buffer(), kind) for c, kind in KINDS.items()})
            yield replace(block, codes=block.codes.reshape(-1, d))


def _hashed(row: np.ndarray, seed: int) -> np.ndarray:
    """Evenly spread numbers in [0, 1) by row and seed."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _bin(edges: list, d: int, base: float):
    """Rows of numbers as rows of codes: 1 + the number of edges below; a category's code is in the table already."""
    edges = [np.array(e, float) if e is not None else None for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, d), np.uint8)
            for i, e in enumerate(edges):
                x = batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float)
                there = ~np.isnan(x)
                codes[there, i] = x[there] if e is None else 1 + np.searchsorted(e, x[there], side="left")
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            yield Block(column("row"), column("y"), column("w"), codes, np.full(batch.num_rows, base)).packed()

    return run


def _sums(d: int, features: list[int], tree: tuple, slots: dict[int, int], unit: float, sample: float, seed: int):
    """Sums of gradients by slot (a leaf of ``tree``), feature and bin of a task's rows; only bins with rows."""
    at_slot = np.full(len(tree[0]), -1)
    for node, slot in slots.items():
        at_slot[node] = slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(slots) * (BINS + 1)
        total = np.zeros((3, len(features), size), np.int64)
        for block in _blocks(batches, d):
            codes = block.codes
            slot = at_slot[place(tree, codes)]
            here = slot >= 0
            if sample < 1:
                here &= _hashed(block.row, seed) < sample
            here = np.flatnonzero(here)
            if not len(here):
                continue
            p = 1 / (1 + np.exp(-block.margin[here]))
            y, w = block.y[here].astype(float), block.w[here]
            g, h = np.rint(w * (p - y) / unit), np.rint(w * p * (1 - p) / unit)
            base = slot[here] * (BINS + 1)
            for k, f in enumerate(features):
                key = base + codes[here, f]
                total[0, k] += np.bincount(key, minlength=size)
                total[1, k] += np.bincount(key, g, size).astype(np.int64)  # below 2^53 in a batch
                total[2, k] += np.bincount(key, h, size).astype(np.int64)
        k, key = np.nonzero(total[0])
        cols = [key // (BINS + 1), np.array(features)[k], key % (BINS + 1)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in cols], *[pa.array(total[i, k, key]) for i in range(3)]], names=["slot", "feature", "bin", "n", "g", "h"])

    return run


def _advance(d: int, trees: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, d):
            yield replace(block, margin=block.after(trees)).packed()

    return run


def _losses(d: int, trees: list[tuple]):
    """Sums of the logistic loss after each of ``trees``, of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(trees)), 0.0
        for block in _blocks(batches, d):
            codes, m, y, w = block.codes, block.margin.copy(), block.y.astype(float), block.w
            weight += w.sum()
            for k, t in enumerate(trees):
                m += t[4][place(t, codes)]
                total[k] += (w * (np.logaddexp(0, m) - y * m)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees), dtype=np.int32)), pa.array(total), pa.array(np.full(len(trees), weight))], names=["k", "loss", "w"])

    return run


@dataclass(frozen=True)
class Growth:
    """How trees grow: what a split gains, and which are allowed."""

    l1: float
    l2: float
    min_rows: int
    min_weight: float
    min_gain: float

    def value(self, g: float, h: float) -> float:
        """What a leaf adds at a rate of 1."""
        return float(-np.sign(g) * max(abs(g) - self.l1, 0.0) / (h + self.l2)) if h + self.l2 > 0 else 0.0

    def _term(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        part = np.maximum(np.abs(g) - self.l1, 0.0)
        return np.divide(part * part, h + self.l2, out=np.zeros_like(part), where=h + self.l2 > 0)

    def best(self, sums: np.ndarray, unit: float, features: list[int], ordered: list[bool]) -> tuple[float, int, np.ndarray, int] | None:
        """(gain, feature, codes that go left, last bin on the left) of ``sums[3, feature, code]``; of equal gains the first feature and bin."""
        found = None
        for k, f in enumerate(features):
            n, g, h = sums[0, k], sums[1, k] * unit, sums[2, k] * unit
            seen = np.flatnonzero(n[1:]) + 1
            if not len(seen):
                continue
            # categories stand by their mean gradient, so that any split by members is one of a prefix
            order = seen if ordered[f] else seen[np.argsort(g[seen] / (h[seen] + max(self.l2, 1e-12)), kind="stable")]
            total = [x.sum() for x in (n, g, h)]
            ln, lg, lh = (np.cumsum(x[order]) for x in (n, g, h))
            whole = self._term(np.array([total[1]]), np.array([total[2]]))[0]
            for missing in (False, True) if n[0] else (False,):  # without missing values they go right
                a, b, c = (x + (v[0] if missing else 0) for x, v in ((ln, n), (lg, g), (lh, h)))
                rn, rg, rh = total[0] - a, total[1] - b, total[2] - c
                gain = self._term(b, c) + self._term(rg, rh) - whole
                fine = (a >= self.min_rows) & (rn >= self.min_rows) & (c >= self.min_weight) & (rh >= self.min_weight) & (gain > self.min_gain + 1e-12)
                if not fine.any():
                    continue
                at = int(np.argmax(np.where(fine, gain, -np.inf)))
                if found is None or gain[at] > found[0] + 1e-12 * abs(found[0]):
                    left = np.zeros(BINS + 1, bool)
                    left[0] = missing
                    if ordered[f]:
                        left[1 : order[at] + 1] = True
                    else:
                        left[order[: at + 1]] = True
                    found = (float(gain[at]), f, left, int(order[at]))
        return found


@dataclass(frozen=True)
class LeafwiseClassifier(Estimator):
    """Boosted trees of at most ``leaves`` leaves (None: any number) and ``depth`` levels (None: any depth), kept as ``TreeModel``.

    A leaf adds -soft(G, l1) / (H + l2) * rate, where G and H sum first and second derivatives of the logistic loss; a split gains
    soft(G)^2 / (H + l2) of its sides less that of the whole, and must exceed ``min_gain``; each side has at least ``min_rows`` rows and
    ``min_weight`` of H.  With ``leaves=None`` and a depth all leaves are split that may be, which is growth by levels.  Rows are drawn anew
    for each tree, and columns.  ``pos_weight`` multiplies the weight of bad rows.  ``start`` is the first score: the mean rate if None.

    Numbers are cut at quantiles into ``BINS`` bins; of a string feature the most frequent values are categories, split by sets of
    them, and all others count as missing.  Missing values go to the side where they gain more, right where training has none.

    With ``validation``, the loss of every number of trees is known; training ends when the least is ``patience`` trees old, and the
    best number of trees is kept.  Rows whose label is not 0 or 1 do not count.  The driver holds, for each waiting leaf, 24 bytes a
    feature and bin; rows never reach it.
    """

    trees: int = 200
    leaves: int | None = 31
    depth: int | None = None
    rate: float = 0.05
    pos_weight: float = 1.0
    min_rows: int = 20
    min_weight: float = 1e-3
    min_gain: float = 0.0
    subsample: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    bins: int = BINS
    start: float | None = None
    patience: int | None = 10
    seed: int = 42
    weight: str | None = None
    scale: LogitScale | None = None
    output: str = "risk_score"

    # --- data --------------------------------------------------------------------------------------------------

    def _rows(self, df: DataFrame, label: str, features: list[str], categories: dict[str, dict[str, float]]) -> DataFrame:
        weight = number(F.col(f"`{self.weight}`")) if self.weight else F.lit(1.0)
        y = F.col(f"`{label}`").cast("double")
        cells = [(coded(f, categories[f]) + 1 if f in categories else number(F.col(f"`{f}`"))).alias(f"x{i}") for i, f in enumerate(features)]
        return df.filter(y.isin(0.0, 1.0)).select(F.monotonically_increasing_id().alias("row"), y.alias("y"), (weight * F.when(y == 1, self.pos_weight).otherwise(1.0)).alias("w"), *cells).filter("w > 0")

    def _categories(self, df: DataFrame, features: list[str]) -> dict[str, dict[str, float]]:
        """The most frequent values of string features; of equally frequent ones the first by name."""
        found = {}
        for f in features:
            if isinstance(df.schema[f].dataType, T.StringType):
                top = df.groupBy(F.col(f"`{f}`").alias("v")).count().filter("v is not null").orderBy(F.desc("count"), "v").limit(self.bins).collect()
                found[f] = {v: float(k) for k, v in enumerate(sorted(r.v for r in top))}
        return found

    def _edges(self, rows: DataFrame, features: list[str], categories: dict) -> list:
        plain = [i for i, f in enumerate(features) if f not in categories]
        cuts = rows.agg(*[F.percentile_approx(f"x{i}", [k / self.bins for k in range(1, self.bins)], ACCURACY).alias(f"x{i}") for i in plain]).first() if plain else {}
        return [sorted(set(cuts[f"x{i}"] or [])) if i in plain else None for i in range(len(features))]

    # --- fitting -----------------------------------------------------------------------------------------------

    def fit(self, df: DataFrame, label: str, features: list[str], context: dict | None = None, validation: DataFrame | None = None) -> TreeModel:
        if not features:
            raise ValueError("no features are left to train on")
        if not 2 <= self.bins <= BINS:
            raise ValueError(f"bins must be between 2 and {BINS}")
        ws = Workspace(df.sparkSession, "growth")
        try:
            return self._fit(df, label, features, validation, ws)
        finally:
            ws.close()

    def _fit(self, df: DataFrame, label: str, features: list[str], validation: DataFrame | None, ws: Workspace) -> TreeModel:
        d = len(features)
        categories = self._categories(df, features)
        rows = self._rows(df, label, features, categories)
        about = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("bad"), F.max("w").alias("most")).first()
        if not about.w or not 0 < about.bad < about.w:
            raise ValueError("training needs rows of both labels")
        share = about.bad / about.w if self.start is None else self.start
        base, unit = log(share / (1 - share)), about.most / UNITS
        edges = self._edges(rows, features, categories)
        binned = ws.save(rows.mapInArrow(_bin(edges, d, base), BINNED), "rows0")
        held = ws.save(self._rows(validation, label, features, categories).mapInArrow(_bin(edges, d, base), BINNED), "held0") if validation is not None else None
        growth = Growth(self.l1, self.l2, self.min_rows, self.min_weight, self.min_gain)

        done, new, losses = [], [], []
        for k in range(self.trees):
            tree = self._tree(binned, d, unit, growth, [e is not None for e in edges], k)
            stuck = len(tree.feature) == 1  # no split is allowed any more
            if not stuck:
                new.append(tree)
            last = k + 1 == self.trees or stuck
            if new and (len(new) == WRITE_EVERY or last):
                arrays, turn = [t.arrays() for t in new], len(done) + len(new)
                if held is not None:
                    got = held.mapInArrow(_losses(d, arrays), "k int, loss double, w double").groupBy("k").agg(F.try_divide(F.sum("loss"), F.sum("w")).alias("loss")).collect()
                    losses += [r.loss for r in sorted(got, key=lambda r: r.k)]
                done, new = done + new, []
                best = int(np.argmin(losses)) if losses and losses[0] is not None else None
                if (best is not None and self.patience is not None and len(losses) - 1 - best >= self.patience):
                    break
                if last:
                    break
                if held is not None:
                    held = ws.save(held.mapInArrow(_advance(d, arrays), BINNED), f"held{turn}")
            if last:
                break
            # margins are written anew after each tree, so that no pass over the rows goes through earlier trees
            binned = ws.save(binned.mapInArrow(_advance(d, [tree.arrays()]), BINNED), f"rows{k + 1}")
            ws.drop(f"rows{k}")
        if losses and losses[0] is not None:
            done = done[: int(np.argmin(losses)) + 1]
        return TreeModel(list(features), [self._nodes(t, edges) for t in done], base, self.scale, self.output, categories=categories)

    def _tree(self, rows: DataFrame, d: int, unit: float, growth: Growth, ordered: list[bool], turn: int) -> Grown:
        rng = random.Random(self.seed * 1_000_003 + turn)
        features = sorted(rng.sample(range(d), max(1, ceil(self.columns * d)))) if self.columns < 1 else list(range(d))
        tree = Grown()
        tree.add(0)
        seed = rng.getrandbits(60)

        def count(nodes: list[int]) -> dict[int, np.ndarray]:
            """Sums by node, from one job; a bounded number of rows for each node."""
            slots = {n: i for i, n in enumerate(nodes)}
            found = rows.mapInArrow(_sums(d, features, tree.arrays(), slots, unit, self.subsample, seed), SUMS).groupBy("slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")]).toArrow()
            out = np.zeros((len(nodes), 3, len(features), BINS + 1), np.int64)
            slot, feature, code = (found.column(c).to_numpy() for c in ("slot", "feature", "bin"))
            for i, c in enumerate(("n", "g", "h")):
                out[slot, i, np.searchsorted(features, feature), code] = found.column(c).to_numpy()
            return dict(zip(nodes, out, strict=True))

        sums, depth, splits, parents = count([0]), {0: 0}, {}, {}
        tree.count[0] = int(sums[0][0, 0].sum())

        def look(node: int) -> None:
            """The best split of a node, if any; its value as a leaf."""
            g, h = (float(sums[node][i, 0].sum()) * unit for i in (1, 2))
            tree.value[node] = growth.value(g, h) * self.rate
            if self.depth is None or depth[node] < self.depth:
                splits[node] = growth.best(sums[node], unit, features, ordered)

        look(0)
        heap = [(-splits[0][0], 0)] if splits.get(0) else []
        leaves, wanted = 1, self.leaves or 1 << 62
        while heap and leaves < wanted:
            top = heap[0][1]
            if top not in parents:  # its children are not counted yet, nor perhaps those of others that may be split
                some = [n for _, n in heapq.nsmallest(min(wanted - leaves, 256), heap) if n not in parents]
                smaller = []
                for n in some:
                    gain, f, left, cut = splits[n]
                    k = features.index(f)
                    on_left = int(sums[n][0, k][left].sum())
                    a, b = tree.add(on_left), tree.add(tree.count[n] - on_left)
                    depth[a] = depth[b] = depth[n] + 1
                    tree.feature[n], tree.lefts[n], tree.cut[n], tree.left[n], tree.right[n], tree.gain[n], tree.ordered[n] = f, left, cut, a, b, gain, ordered[f]
                    smaller.append(a if tree.count[a] <= tree.count[b] else b)
                counted = count(smaller)
                for n, small in zip(some, smaller, strict=True):
                    a, b = tree.left[n], tree.right[n]
                    sums[small] = counted[small]
                    sums[b if small == a else a] = sums.pop(n) - counted[small]
                    parents[n] = (a, b)
                    look(a)
                    look(b)
                continue
            heapq.heappop(heap)
            leaves += 1
            splits[top] = None
            for child in parents.pop(top):
                if splits.get(child):
                    heapq.heappush(heap, (-splits[child][0], child))
        # what was counted ahead and not split stays a leaf
        for n in list(parents):
            tree.left[n] = tree.right[n] = tree.feature[n] = -1
            tree.gain[n] = 0.0
        return tree

    def _nodes(self, tree: Grown, edges: list) -> list[Node]:
        nodes: list[Node] = []

        def put(k: int) -> int:
            at = len(nodes)
            nodes.append(Node(leaf=tree.value[k], cover=float(tree.count[k])))
            if tree.left[k] >= 0:
                f, lefts = tree.feature[k], tree.lefts[k]
                how = {"threshold": float(edges[f][tree.cut[k] - 1]) if tree.cut[k] <= len(edges[f]) else float("inf")} if tree.ordered[k] else {"mode": "in", "members": tuple(float(c - 1) for c in np.flatnonzero(lefts[1:]) + 1)}
                nodes[at] = replace(nodes[at], leaf=None, feature=f, missing_left=bool(lefts[0]), gain=tree.gain[k], left=put(tree.left[k]), right=put(tree.right[k]), **how)
            return at

        put(0)
        return nodes
