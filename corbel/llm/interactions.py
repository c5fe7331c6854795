"""Filter interaction audit: what each filter removes in every order of the filters, and its Shapley value.

Each document has a mask of the filters that it fails, so a part of the corpus is a table of at most 2^k counts (cells).  All k!
orders are visited by exchanging neighbours; an exchange changes only what the two filters themselves remove, so only these
two steps are counted anew from the cells, and the Shapley values add up along the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.workspace import Workspace

#: The most filters of an audit: 5,040 orders of 7 steps a part.
MOST_FILTERS = 7
#: Parts whose orders are visited together.
PARTS = 100

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> dict[str, Column]:
    """Four filters of a text: too few words, too few different words, too many capitals, symbols.  No text is null here."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 2 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def swaps(n: int) -> Iterator[int]:
    """Places whose element is exchanged with the next one: n! - 1 exchanges that visit every order of n once."""
    if n < 2:
        return
    back, inner = True, swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if back else range(n - 1)
        other = next(inner, None)
        if other is None:
            return
        yield other + back  # the last element stands before the others after its way back
        back = not back


def walk(cells: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Orders, removed[order, step, part, kind] and shapley[filter, part] of ``cells[part, kind, mask]``; kind 0 counts documents."""
    masks = np.arange(1 << k)
    fails = [(masks >> f & 1).astype(bool) for f in range(k)]
    order = list(range(k))
    now = np.zeros((k, *cells.shape[:2]), np.int64)
    shapley = np.zeros((k, len(cells)), np.int64)

    def count(step: int) -> None:
        left = (masks & sum(1 << f for f in order[:step])) == 0
        now[step] = cells[:, :, left & fails[order[step]]].sum(axis=2)

    for step in range(k):
        count(step)
    orders, removed = [], np.empty((factorial(k), *now.shape), np.int64)

    def visit() -> None:
        removed[len(orders)] = now
        orders.append(tuple(order))
        shapley[order] += now[:, :, 0]

    visit()
    for i in swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        count(i)
        count(i + 1)
        visit()
    return orders, removed, shapley


def _report(names: str):
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                rows = batch.slice(lo, PARTS)
                parts, p = rows.column("part"), rows.num_rows
                cells = np.zeros((p, 3, 1 << k), np.int64)
                at, inner = rows.column("cells"), rows.column("cells").flatten()
                part = np.repeat(np.arange(p), at.value_lengths().to_numpy())
                mask = inner.field("mask").to_numpy()
                for kind, name in enumerate(("n", "good", "toxic")):
                    cells[part, kind, mask] = inner.field(name).to_numpy()
                orders, removed, shapley = walk(cells, k)
                n = cells[:, 0]
                masks = np.arange(1 << k)
                failing = np.stack([n[:, (masks >> f & 1).astype(bool)].sum(axis=1) for f in range(k)])
                alone = np.stack([n[:, 1 << f] for f in range(k)])
                # by part, order and step
                which = np.array(orders)
                gone = removed.transpose(2, 0, 1, 3)
                kept = n.sum(axis=1)[:, None, None] - gone[..., 0].cumsum(axis=2)
                by_filter = lambda x: x[which].transpose(2, 0, 1)
                text = np.array(["".join(names[f] for f in o) for o in orders])
                shape = (p, len(orders), k)
                cols = [
                    parts.take(pa.array(np.repeat(np.arange(p), len(orders) * k))),
                    pa.array(text).take(pa.array(np.broadcast_to(np.arange(len(orders))[None, :, None], shape).ravel())),
                    pa.array(np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), shape).ravel()),
                    *[pa.array(np.ascontiguousarray(x).ravel()) for x in (kept, gone[..., 0], by_filter(failing) - gone[..., 0], by_filter(alone), gone[..., 1], gone[..., 2], by_filter(shapley))],
                ]
                names_ = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
                yield pa.RecordBatch.from_arrays(cols, names=names_)

    return run


def audit_cells(cells: DataFrame, names: str) -> DataFrame:
    """The audit of ``cells(part, mask, n, good, toxic)``: one row per part, order and step.  ``names`` has a letter a filter, lowest bit first."""
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"one to {MOST_FILTERS} different letters are needed, not {names!r}")
    # at most 2^k cells a part
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_report(names), SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame, failing: Mapping[str, Column] | None = None, duplicates: str = "E", id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter removes at each step of every order, by part of ``docs``; see ``SCHEMA``.

    ``failing`` gives a condition for each letter (by default ``failures`` of the text, null being empty; a condition that is
    null is not met); a document also fails ``duplicates`` if a smaller id has the identical text, whatever the filters did
    to that one.  ``labels(doc_id, quality, toxic)`` may cover some documents; if it repeats an id, one label of 1 is enough.
    A null part is the empty string.  Each row counts: rows that repeat an id and text are no duplicates of each other;
    a row without an id is nobody's duplicate and has no labels.  No documents give no rows.  Columns besides those named are
    used only by ``failing``.
    """
    ws = Workspace(docs.sparkSession, "interactions")
    given = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    failing = failures(given) if failing is None else failing
    names = "".join(failing) + duplicates
    mask = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing.values())])
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(given, 256)).alias("digest"))
    rows = ws.save(rows, "rows")

    # the first document of each text joins by text and id, so that copies of one text do not meet in one task
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    again = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(failing)).otherwise(0)
    known = rows.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + again).join(marks, "id", "left")
    cells = known.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return audit_cells(cells, names)
