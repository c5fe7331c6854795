"""Benchmark decontamination: a broadcast set of normalised test n-grams against every window of every text."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.llm.wordhash import ALNUM_WORDS, window_hashes, words_by_block
from corbel.workspace import Workspace

#: Benchmark windows are broadcast if they take at most so many bytes in a worker; more are joined by their hash.
BROADCAST_BYTES = 96 << 20
#: Bytes that a window takes besides its words and its item's name.
WINDOW_BYTES = 300
_FILTER = 1 << 20


class WindowSet:
    """Windows by width: their hashes, and for the words themselves the items that hold them."""

    def __init__(self, windows: list[tuple[int, bytes, int, str]]):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        widths: dict[int, set[int]] = defaultdict(set)
        for width, words, code, item in windows:
            self.items[words].add(item)
            widths[width].add(code & (1 << 64) - 1)
        self.widths = []
        for width, codes in sorted(widths.items()):
            known = np.array(sorted(codes), np.uint64)
            mask = np.zeros(_FILTER, bool)
            mask[(known & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.widths.append((width, known, mask))

    def occurrences(self, part: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, width, items) of each verified occurrence; no window spans two rows."""
        for width, known, mask in self.widths:
            codes = window_hashes(hashes, width)
            at = np.flatnonzero(mask[(codes & np.uint64(_FILTER - 1)).astype(np.int64)])
            at = at[row[at] == row[at + width - 1]]
            slot = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
            for i in at[known[slot] == codes[at]]:
                words = b" ".join(part[a:b].tobytes() for a, b in zip(starts[i : i + width], ends[i : i + width], strict=True))
                if items := self.items.get(words):
                    yield int(i), width, items


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column("item_id").cast(pa.string()).fill_null("").to_pylist()
            for lo, hi, part, _, split, starts, ends, hashes in words_by_block(batch.column("text"), ALNUM_WORDS):
                for r in range(hi - lo):
                    a, b = split[r], split[r + 1]
                    width = min(size, b - a)
                    for i, code in enumerate(window_hashes(hashes[a:b], width).view(np.int64), a):
                        out.append((int(width), b" ".join(part[x:y].tobytes() for x, y in zip(starts[i : i + width], ends[i : i + width], strict=True)), int(code), ids[lo + r]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.string()), strict=True)], names=["width", "words", "code", "item"])

    return run


def _row_sets(batch: pa.RecordBatch, given: WindowSet | None) -> Iterator[tuple]:
    """For every block of rows the words and, by row, occurrences (first word, width) and the names of items."""
    own = None if given else batch.column("found").to_pylist()
    for lo, hi, part, cuts, split, starts, ends, hashes in words_by_block(batch.column("text"), ALNUM_WORDS):
        hits: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
        if given:
            row = np.searchsorted(split, np.arange(len(starts)), side="right") - 1
            for i, width, items in given.occurrences(part, row, starts, ends, hashes):
                at, names = hits[int(row[i])]
                at.append((i, width))
                names |= items
        else:
            for r in range(hi - lo):
                if own[lo + r]:
                    hits[r] = ([(x["first"] + split[r], x["width"]) for x in own[lo + r]["at"]], set(own[lo + r]["items"]))
        yield lo, hi, cuts, split, starts, ends, hits


def _covered(n: int, first: int, at: list) -> np.ndarray:
    hit = np.zeros(n, bool)
    for i, width in at:
        hit[i - first : i - first + width] = True
    return hit


def _report(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for lo, hi, _, split, _, _, hits in _row_sets(batch, broadcast and broadcast.value):
                for r in range(hi - lo):
                    n_words.append(int(split[r + 1] - split[r]))
                    at, names = hits.get(r, ((), ()))
                    n_hit.append(int(_covered(n_words[-1], split[r], at).sum()))
                    items.append(sorted(names))
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            cols = [batch.column("given").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    return run


def _cut(broadcast, action: str, share: float, fields: T.StructType):
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            for lo, _, cuts, split, starts, ends, hits in _row_sets(batch, broadcast and broadcast.value):
                for r, (at, _) in hits.items():
                    a, b = split[r], split[r + 1]
                    hit = _covered(b - a, a, at)
                    if action == "document" or hit.mean() > share:
                        keep[lo + r] = False
                        continue
                    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    raw, done, left = texts[lo + r].encode(), 0, []
                    for x, y in zip(edge[::2], edge[1::2], strict=True):
                        left.append(raw[done : starts[a + x] - cuts[r]])
                        done = ends[a + y - 1] - cuts[r]
                    texts[lo + r] = b"".join([*left, raw[done:]]).decode()
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64())
            given = dict(zip([n for n in names if n != "text"], batch.column("given").flatten(), strict=False))
            out = pa.RecordBatch.from_arrays([new[c] if c in new else given[c] for c in names], names=names)
            yield out.filter(pa.array(keep))

    return run


def _codes(widths: list[int]):
    """Each text's key with the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, _, _, split, _, _, hashes in words_by_block(batch.column("text"), ALNUM_WORDS):
                row = np.searchsorted(split, np.arange(len(hashes)), side="right") - 1
                for w in widths:
                    h = window_hashes(hashes, w)
                    at = np.flatnonzero(row[: len(h)] == row[w - 1 : w - 1 + len(h)])
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row[at] + lo)), pa.array(h[at].view(np.int64))], names=["key", "code"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with the hashes that they share with the benchmark: where those windows stand, and their words."""
    for batch in batches:
        out, codes = [], batch.column("codes").to_pylist()
        keys, widths = batch.column("key").to_pylist(), batch.column("widths").to_pylist()
        for lo, hi, part, _, split, starts, ends, hashes in words_by_block(batch.column("text"), ALNUM_WORDS):
            for r in range(hi - lo):
                a, b = split[r], split[r + 1]
                wanted = np.array(sorted(codes[lo + r]), np.int64)
                for w in widths[lo + r]:
                    for i in np.flatnonzero(np.isin(window_hashes(hashes[a:b], w).view(np.int64), wanted)):
                        words = b" ".join(part[x:y].tobytes() for x, y in zip(starts[a + i : a + i + w], ends[a + i : a + i + w], strict=True))
                        out.append((keys[lo + r], int(i), w, words))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "first", "width", "words"])


def _with_windows(docs: DataFrame, benchmark: DataFrame, size: int, limit: int, ws: Workspace) -> tuple[DataFrame, object]:
    """``docs(given, text)`` and the broadcast window set; with too large a benchmark, ``docs`` with what was found in each text.

    Then each different text sends its windows' hashes once; those that the benchmark has come back, and where they stand
    is joined with the benchmark's windows by their words, for verification and for the items.
    """
    windows = ws.save(benchmark.select("item_id", "text").mapInArrow(_windows(size), "width int, words binary, code long, item string").distinct(), "windows")
    held = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + F.lit(WINDOW_BYTES)).alias("n")).first().n or 0
    if held <= limit:
        rows = [(r.width, bytes(r.words), r.code, r.item) for r in windows.toLocalIterator()]
        return docs, docs.sparkSession.sparkContext.broadcast(WindowSet(rows))

    widths = [r.width for r in windows.select("width").distinct().collect()]  # at most ``size`` values
    key = F.md5(F.coalesce("text", F.lit("")))
    texts = ws.save(docs.select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text")), "texts")
    codes = windows.select("code", "width").distinct()
    sent = texts.mapInArrow(_codes(widths), "key string, code long").distinct()
    shared = ws.save(sent.join(codes, "code").groupBy("key").agg(F.collect_set("code").alias("codes"), F.collect_set("width").alias("widths")), "shared")
    places = ws.save(texts.join(shared, "key").mapInArrow(_places, "key string, first int, width int, words binary"), "places")
    known = windows.select("width", "words").distinct()
    at = places.join(known, ["width", "words"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("first", "width")).alias("at"))
    items = places.select("key", "width", "words").distinct().join(windows.select("width", "words", "item"), ["width", "words"]).select("key", "item").distinct()
    items = items.groupBy("key").agg(F.collect_list("item").alias("items"))
    found = ws.save(at.join(items, "key").select(F.col("key").alias("found_key"), F.struct("at", "items").alias("found")), "found")
    return docs.withColumn("key", key).join(found, F.col("key") == F.col("found_key"), "left").select("given", "text", "found"), None


def scan_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, limit: int = BROADCAST_BYTES, ws: Workspace | None = None) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> per row doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of digits, a-z (A-Z folded) and non-ASCII characters.  A benchmark item's windows are its
    runs of ``size`` words; an item with fewer, but not none, is one window.  A word inside an occurrence of any
    window is hit.  A null or empty text has no words and no hits; an empty benchmark hits nothing.  Repeated
    items count once by ``item_id``; a null ``item_id`` counts as the item named by an empty string.  Hash matches
    are verified word for word.  Repeated rows are reported each; other columns are ignored.  Windows of more than
    ``limit`` bytes are not broadcast but joined.
    """
    ws = ws or Workspace(docs.sparkSession, "leaks")
    given, shared = _with_windows(docs.select(F.col("doc_id").alias("given"), "text"), benchmark, size, limit, ws)
    return given.mapInArrow(_report(shared), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, action: str = "span", share: float = 0.5, limit: int = BROADCAST_BYTES, ws: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` without benchmark passages, same columns; ``n_chars``, if there, follows the text.

    ``action="span"`` cuts each run of hit words, from its first letter to its last, and drops a document of which more
    than ``share`` of the words are hit; ``action="document"`` drops every document with a hit.  Rows without hits come
    back unchanged, null and empty texts too; repeated rows are treated alike; an empty table stays empty.
    """
    if action not in ("span", "document"):
        raise ValueError(f"action must be 'span' or 'document', not {action!r}")
    ws = ws or Workspace(docs.sparkSession, "leaks")
    # the columns of ``docs`` travel as one, so that none clashes with those made here
    given, shared = _with_windows(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0)]).alias("given"), "text"), benchmark, size, limit, ws)
    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema])
    return given.mapInArrow(_cut(shared, action, share, schema), schema)
