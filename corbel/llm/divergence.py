"""Source divergence audit: how far the word use of each source is from the other sources of its language, and from the language.

Terms are runs of letters and of bytes above 0x7F, found by a lookup table over the concatenated UTF-8 bytes of many texts.
xxHash groups the slices, and every slice is held against the bytes of its group.  Counts by source are cut into blocks of
terms; each block becomes a sparse matrix (CSR: sources by terms), and the divergences of its sources are sums over the
rows of that matrix (reduceat).  Sums of blocks add up, so no task holds a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.llm.wordhash import lowered, release_memory, row_blocks
from corbel.workspace import Workspace

#: A term is kept in a language if at least so many of its documents hold it.
MIN_DOCS = 10
#: Probabilities are parts of this.
UNIT = 1_000_000_000
#: The terms reported for a source.
TOP = 10
#: Bytes of text that are cut into terms at once, and counts of a block of terms.
TEXT_BYTES = 1 << 22
BLOCK_COUNTS = 1 << 17
#: Sources compared in one task: those of one or two tiles.
TILE = 256

#: Which bytes belong to terms, after A-Z were folded.
TERM = np.zeros(256, bool)
TERM[ord("a") : ord("z") + 1] = True
TERM[0x80:] = True


def boundaries(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of ``buf``; none goes over a cut."""
    inside = TERM[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < len(buf))]
    first[at], last[at - 1] = inside[at], inside[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _bytes_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all bytes of slices, slice after slice."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def group_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(the first slice of each group, the group of each slice): slices with the same bytes are a group."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = buf.tobytes()
    codes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    group, found = pd.factorize(codes)  # by hashing: nothing is sorted
    first = np.empty(len(found), np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    sizes, like = ends - starts, first[group]
    odd = sizes != sizes[like]
    check = np.flatnonzero(~odd & (like != np.arange(len(like))))
    if len(check):
        same = buf[_bytes_of(starts[check], sizes[check])] == buf[_bytes_of(starts[like[check]], sizes[check])]
        odd[check] = ~np.logical_and.reduceat(same, np.r_[0, np.cumsum(sizes[check])[:-1]])
    if odd.any():  # two texts of one hash: groups by their bytes
        others: dict[bytes, int] = {}
        for i in np.flatnonzero(odd):
            k = others.setdefault(raw[starts[i] : ends[i]], len(first))
            if k == len(first):
                first = np.append(first, i)
            group[i] = k
    return first, group


def _long_row(buf: np.ndarray) -> Counter:
    """Terms of one long text, cut in pieces after bytes that belong to no term."""
    found: Counter = Counter()
    lo = 0
    while lo < len(buf):
        hi = min(lo + TEXT_BYTES, len(buf))
        while hi < len(buf):
            gap = np.flatnonzero(~TERM[buf[lo:hi]])
            if len(gap):
                hi = lo + int(gap[-1]) + 1
                break
            hi = min(hi + TEXT_BYTES, len(buf))  # one term longer than the piece
        part = buf[lo:hi]
        starts, ends = boundaries(part, np.zeros(0, np.int64))
        first, group = group_slices(part, starts, ends)
        for i, n in zip(first, np.bincount(group, minlength=len(first)), strict=True):
            found[part[starts[i] : ends[i]].tobytes()] += int(n)
        lo = hi
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the blocks of texts; a row without a term for each source that occurs."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        release_memory()
        of: dict[tuple[str, str], int] = {}
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group_of_row = np.fromiter((of.setdefault(x, len(of)) for x in pairs), np.int64, batch.num_rows)
        langs, sources = pa.array([x[0] for x in of], pa.string()), pa.array([x[1] for x in of], pa.string())
        zero = pa.array(np.zeros(len(of), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(of), pa.string()), zero, zero], names=names)
        buf, offsets = lowered(batch.column("text"))
        for lo, hi in row_blocks(offsets, TEXT_BYTES):
            part, cuts = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if len(part) > 2 * TEXT_BYTES:  # a single row
                found = _long_row(part)
                terms, n = pa.array(list(found), pa.binary()), np.fromiter(found.values(), np.int64, len(found))
                group, docs = np.full(len(found), group_of_row[lo]), np.ones(len(found), np.int64)
            else:
                starts, ends = boundaries(part, cuts)
                first, term = group_slices(part, starts, ends)
                if not len(first):
                    continue
                row = np.searchsorted(cuts, starts, side="right") - 1
                of_pair, pair = pd.factorize(row * len(first) + term)  # of a text and a term
                of_key, key = pd.factorize(group_of_row[lo + pair // len(first)] * len(first) + pair % len(first))
                n, docs = np.bincount(of_key, np.bincount(of_pair), len(key)), np.bincount(of_key, minlength=len(key))
                group = key // len(first)
                terms = pa.array([part[starts[i] : ends[i]].tobytes() for i in first], pa.binary()).take(pa.array(key % len(first)))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), terms.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names=names)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most UNIT + 1, so nothing overflows.  Absent terms (0, 0) give 0."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix with the bounds ``ends`` (0 first); empty rows are 0."""
    out, full = np.zeros(len(ends) - 1, np.int64), np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.int64, copy=False), ends[full])
    return out


def block_divergences(table: pa.Table) -> pa.Table:
    """The part of the divergence of each pair of sources that one block of terms holds.

    Rows are (lang, block, tile_a, tile_b, tile, source, term, p, p0, n_terms); p0 is the probability of a term that the source lacks, and
    each source has a row without a term.  ``total`` is over terms that one of the two has; ``both`` is their number; a term
    that neither has adds ``absent``.
    """
    own = table.column("term").is_null().to_numpy(zero_copy_only=False)
    names = pc.unique(table.column("source")).sort()  # in every block a pair stands the same way round
    source = pc.index_in(table.column("source"), value_set=names).to_numpy()
    tile, p0 = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    tile[source], p0[source] = table.column("tile").to_numpy(), table.column("p0").to_numpy()
    ta, tb = table.column("tile_a")[0].as_py(), table.column("tile_b")[0].as_py()
    terms = table.column("term").filter(pa.array(~own)).combine_chunks().dictionary_encode()
    term, p, source = terms.indices.to_numpy(), table.column("p").to_numpy(zero_copy_only=False)[~own].astype(np.int64), source[~own]
    order = np.lexsort((term, source))
    term, p, source = term[order], p[order], source[order]
    ends = np.searchsorted(source, np.arange(len(names) + 1))
    sizes = np.diff(ends)
    x, has = np.empty(len(terms.dictionary), np.int64), np.zeros(len(terms.dictionary), bool)
    out = []
    for s in np.flatnonzero(tile == ta):
        mine = slice(ends[s], ends[s + 1])
        x[:] = p0[s]
        x[term[mine]] = p[mine]
        has[term[mine]] = True
        total = row_sums(divergence(x[term], p), ends)  # over the terms of the other source
        shared = has[term]
        both = row_sums(shared, ends)
        # over the terms of s, the other source lacking them; those it does have are taken back
        lacking = np.fromiter((divergence(p[mine], q).sum() for q in p0), np.int64, len(p0))
        at = np.flatnonzero(shared)
        back = row_sums(divergence(x[term[at]], p0[source[at]]), np.searchsorted(source[at], np.arange(len(names) + 1)))
        has[term[mine]] = False
        others = np.flatnonzero((tile == tb) & ((np.arange(len(names)) > s) | (ta != tb)))
        out.append((np.full(len(others), s), others, (total + lacking - back)[others], (sizes[s] + sizes - both)[others], divergence(p0[s], p0[others])))
    a, b, total, both, absent = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
    lang, n_terms = table.column("lang")[0].as_py(), table.column("n_terms")[0].as_py()
    cols = [pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), *[pa.array(c.astype(np.int64)) for c in (total, both, absent)], pa.array(np.full(len(a), n_terms, np.int64))]
    return pa.Table.from_arrays(cols, names=["lang", "a", "b", "total", "both", "absent", "n_terms"])


def _share(n: str, all_: str, terms: str) -> str:
    """1 + floor(UNIT * (n + 2) / (all + 2 * terms)), exact; 0 where no term is kept."""
    return f"CASE WHEN {terms} = 0 THEN 0 ELSE 1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {UNIT}) DIV CAST({all_} + 2 * {terms} AS DECIMAL(20, 0)) END"


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of each source of each language.

    Part ``pair``: every other source of the language, by divergence.  Part ``term``: the ``top`` terms that the source uses more than
    its language does.  Nulls in text, language and source are empty strings.  Ties in value rank by the item's bytes.
    Repeated rows are documents of their own.  Texts without terms count for their source; a language without kept terms has
    pairs of value 0 and no terms; a source alone in its language has no pairs.  No documents give no rows.
    """
    ws = Workspace(docs.sparkSession, "divergence")
    given = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = given.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = ws.save(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    # a term's rows of one language are at most its sources
    term = Window.partitionBy("lang", "term")
    kept = counts.filter("term is not null").withColumns({"in_docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "head": F.min("source").over(term) == F.col("source")}).filter(F.col("in_docs") >= min_docs).drop("docs", "in_docs")
    kept = ws.save(kept, "kept")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    by_lang = kept.groupBy("lang").agg(F.sum(F.when(F.col("head"), F.col("n_lang"))).alias("all_lang"), F.count(F.when(F.col("head"), 1)).alias("n_terms"), F.count("*").alias("cells"))
    groups = counts.filter("term is null").select("lang", "source")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    groups = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").join(tiles, "lang").fillna(0, ["all", "all_lang", "n_terms", "cells"])
    groups = groups.withColumns({"tile": F.pmod(F.xxhash64("source"), F.col("tiles")), "blocks": F.greatest(F.lit(1), F.ceil(F.col("cells") / BLOCK_COUNTS)), "p0": F.expr(_share("0", "all", "n_terms"))})
    groups = ws.save(groups.withColumn("blocks", F.col("blocks").cast("long")), "groups")

    of = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "all", "n_terms")))
    used = of.withColumn("q", F.expr(_share("n_lang", "all_lang", "n_terms"))).filter("p > q")
    used = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) DIV (p + q)").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = used.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    cells = of.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "tile", "tiles", "source", "term", "p", "p0", "n_terms")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tile", "tiles", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "p0", "n_terms")
    rows = cells.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "tile", "source", "term", "p", "p0", "n_terms")
    parts = rows.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(block_divergences, "lang string, a string, b string, total long, both long, absent long, n_terms long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("both").alias("both"), F.max("absent").alias("absent"), F.max("n_terms").alias("n_terms"))
    sums = sums.withColumn("value", F.col("total") + (F.col("n_terms") - F.col("both")) * F.col("absent"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", ways.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(used)
