"""Embedding near-duplicates: tiles of vectors, every two of them compared as matrices.

Distinct vectors are packed into tiles, one row each, and written once.  A Cartesian product joins the tiles with themselves: its tasks
read partitions of tiles from where they were written, so vectors are never shuffled to the places where they are compared, and disk
grows with the vectors and not with their pairs.  Each pair of tiles is compared once: a product in single precision, with room for its
rounding, leaves what may reach the cosine, and double precision decides.  A tile pair returns counts for vectors and a spanning set of
links, never a row for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.components import connected_components
from corbel.llm.wordhash import release_memory
from corbel.workspace import Workspace

#: Vectors of a tile; two tiles are what a task compares at a time.
TILE = 2048
#: Tiles of a file at least, where there are as many: a task of the product holds those of one partition, in a bounded part of memory.
FILE_TILES = 4
PACKED = "dims int, key array<binary>, least array<long>, copies array<long>, vec binary"


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """Rows as float64; null for vectors that are null, empty, zero or hold nulls or non-finite values."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = x.values
        ok = v is not None and len(v) > 0 and v.null_count == 0
        a = v.to_numpy(zero_copy_only=False).astype(np.float64) if ok else None
        out.append(a if a is not None and np.isfinite(a).all() and a.any() else None)
    return out


def _keys(kind: str):
    """``kind`` is how a vector's numbers are kept: single precision if that is how they came, half of what is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release_memory()
            yield _keyed(batch, kind)

    return run


def _keyed(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    found = [(a + 0.0).astype(kind).tobytes() if a is not None else None for a in _lists(batch.column("embedding"))]
    keys = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in found]
    dims = [len(x) // np.dtype(kind).itemsize if x else None for x in found]
    return pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(found, pa.binary())], names=["vec_id", "key", "dims", "vec"])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _pack(size: int):
    """Rows (key, least_id, copies, dims, vec) as tiles of at most ``size`` vectors of one length."""

    def tile(dims: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda name: [x for p in parts for x in p.column(name).to_pylist()]
        lists = [pa.array([column(name)], pa.list_(kind)) for name, kind in (("key", pa.binary()), ("least_id", pa.int64()), ("copies", pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *lists, pa.array([b"".join(column("vec"))], pa.binary())], names=["dims", "key", "least", "copies", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            release_memory()
            for dims in pc.unique(batch.column("dims")).to_pylist():
                some = batch.filter(pc.equal(batch.column("dims"), dims))
                while some.num_rows:
                    parts = held.setdefault(dims, [])
                    parts.append(some.slice(0, size - sum(p.num_rows for p in parts)))
                    some = some.slice(parts[-1].num_rows)
                    if sum(p.num_rows for p in parts) == size:
                        yield tile(dims, held.pop(dims))
        for dims, parts in held.items():
            yield tile(dims, parts)

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _compare(cosine: float, kind: str):
    """Rows (dims, same, left and right tile) -> (key, n, other): counts, and links that span what is linked."""

    def unit(batch: pa.RecordBatch, side: str, r: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(batch.column(f"{side}_vec")[r].as_buffer(), kind).reshape(-1, batch.column("dims")[r].as_py())
        exact = _unit(raw.astype(np.float64))
        return exact, exact.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, left = None, None
        for batch in batches:
            release_memory()
            keys, counts, others = [], [], []
            for r in range(batch.num_rows):
                same = batch.column("same")[r].as_py()
                if batch.column("l_tile")[r].as_py() != seen:  # a left tile meets one right tile after the other
                    seen, left = batch.column("l_tile")[r].as_py(), unit(batch, "l", r)
                right = left if same else unit(batch, "r", r)
                (p, p_short), (q, q_short) = left, right
                slack = np.float32(1.2e-7 * (p.shape[1] + 16))  # more than single precision can be off
                i, j = np.divmod(np.flatnonzero(p_short @ q_short.T >= np.float32(cosine) - slack), len(q))
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                copies = [np.array(batch.column(f"{side}_copies")[r].as_py(), np.int64) for side in "lr"]
                names = [batch.column(f"{side}_key")[r].values for side in "lr"]
                forest = _Forest(len(p) + len(q))
                for at in range(0, len(i), 50_000):
                    a, b = i[at : at + 50_000], j[at : at + 50_000]
                    ok = np.einsum("ij,ij->i", p[a], q[b]) >= cosine
                    a, b = a[ok], b[ok]
                    for name, idx, weight in ((names[0], a, copies[1][b]), (names[1], b, copies[0][a])):
                        total = np.bincount(idx, weight, len(name)).astype(np.int64)
                        for x in np.flatnonzero(total).tolist():
                            keys.append(name[x].as_py())
                            counts.append(int(total[x]))
                            others.append(None)
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        if forest.join(x, y + (0 if same else len(p))):
                            keys.append(names[0][x].as_py())
                            counts.append(0)
                            others.append(names[1][y].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(others, pa.binary())], names=["key", "n", "other"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, ws: Workspace | None = None) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> per row vec_id, n_links, component_id, kept.

    Two rows link when the cosine of their embeddings, in double precision, is at least ``cosine``; rows with equal
    embeddings link.  ``n_links`` counts the other rows linked directly, ``component_id`` is the least ``vec_id``
    reachable, itself included, ``kept`` says that it is the row's own (false for a null id).  Embeddings that are
    null, empty, zero, or hold nulls or non-finite values link with nothing; those of different lengths neither.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "vectors")
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    keyed = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_keys(kind), "vec_id long, key binary, dims int, vec binary")
    rows = ws.save(keyed.select("vec_id", "key"), "rows")
    classes = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("vec").alias("vec"))
    files = max(1, ceil(rows.count() / (FILE_TILES * TILE)))
    tiles = ws.save(classes.coalesce(files).mapInArrow(_pack(TILE), PACKED).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    found = ws.save(_pairs(tiles).mapInArrow(_compare(cosine, kind), "key binary, n long, other binary"), "found")
    comp = connected_components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), ws)
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    named = tiles.select(F.explode(F.arrays_zip("key", "least", "copies")).alias("x")).select("x.key", F.col("x.least").alias("least_id"), "x.copies")
    named = named.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = ws.save(named.join(least, "root").join(links, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "by-class")
    ws.drop("tiles", "found")
    out = rows.join(by_class, "key", "left")
    component = F.when(F.col("key").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _pairs(tiles: DataFrame) -> DataFrame:
    """Every two tiles of one length once, and each with itself.

    Of two tiles now the lesser stands left and now the greater, by turns, so that all tasks of the product have alike much to do.
    """
    side = lambda s: tiles.select(*[F.col(c).alias(f"{s}_{c}") for c in ("tile", "dims", "key", "copies", "vec")])
    number = lambda c: F.col(c) + F.shiftright(c, 33)
    even = (number("l_tile") + number("r_tile")) % 2 == 0
    once = (F.col("l_tile") == F.col("r_tile")) | (F.when(even, F.col("l_tile") < F.col("r_tile")).otherwise(F.col("l_tile") > F.col("r_tile")))
    met = side("l").join(side("r").hint("shuffle_replicate_nl"), (F.col("l_dims") == F.col("r_dims")) & once)
    return met.select(F.col("l_dims").alias("dims"), (F.col("l_tile") == F.col("r_tile")).alias("same"), "l_tile", "l_key", "l_copies", "l_vec", "r_key", "r_copies", "r_vec")
