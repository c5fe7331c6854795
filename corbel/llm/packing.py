"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Texts become token ids once; pieces are dealt to shards of bounded size.  A shard is packed by several
islands, each a small population that Spark runs in its own task.  A solution is a list of bins.  Crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold a duplicate of an
injected piece, exchanges the pieces so displaced with shorter ones, and best-fits what is left.  After an epoch an island's best solution moves to the
next island of its shard.  A shard stops as soon as its best solution meets the lower bound.
Last, the worst-filled bins of all shards are taken apart and packed once more together.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.wordhash import hash_spans, lowered, release_memory, row_blocks
from corbel.workspace import Workspace

#: Pieces of a shard, on average; the bound of what one task packs.
SHARD_PIECES = 6000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CHILDREN = 12


# --- token ids ---------------------------------------------------------------------------------------------------

_BLANK, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)


def _byte_classes() -> np.ndarray:
    """What the tokenizer file's splitting rule does with each byte of a folded ASCII text.

    Runs of letters, single digits and runs of marks are pieces.  A word with an apostrophe (it may begin a contraction), a
    control character or a byte of another script is left whole, for the tokenizer itself to split.
    """
    out = np.full(256, _WHOLE, np.uint8)
    out[0x21:0x7F] = _MARK
    out[0x61:0x7B], out[0x30:0x3A], out[0x27] = _LETTER, _DIGIT, _WHOLE
    out[[0x20, *range(0x09, 0x0E)]] = _BLANK
    return out


_CLASS = _byte_classes()
#: Second bytes of the letters U+00C0-U+00FF, which follow 0xC3; the signs for times and divided by are none.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def pieces(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the pieces of texts that ``cuts`` delimits in the folded UTF-8 bytes ``part``."""
    kind, n = _CLASS[part], len(part)
    latin = np.flatnonzero((part[:-1] == 0xC3) & _LATIN[part[1:]])
    kind[latin] = kind[latin + 1] = _LETTER
    cut = cuts[(cuts > 0) & (cuts < n)]
    if (kind == _WHOLE).any():
        inside = kind != _BLANK
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        whole = np.add.reduceat(kind == _WHOLE, starts, dtype=np.int64) > 0
        step = np.zeros(n + 1, np.int8)
        step[starts[whole]] += 1
        np.subtract.at(step, ends[whole], 1)
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = _WHOLE
    some = kind != _BLANK
    first = some.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    first[cut] = some[cut]
    last = some.copy()
    last[:-1] &= first[1:] | ~some[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, kind[starts]


class PieceIds:
    """Token ids of the pieces of texts, each distinct piece encoded once by the given tokenizer.

    The vocabulary's rules drop white space and never look past it, so a text's ids are those of its words in a row, and
    a plain word's those of its pieces.  A hash table holds what is known by the 64-bit hash of the piece's folded bytes
    (the tokenizer folds case itself), so a block of text costs a few array look-ups.
    """

    #: Places of the hash table; it is cleared when it is more than two fifths full.
    PLACES = 1 << 21
    #: Pieces that are encoded in one string.
    JOINED = 128

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.number = np.zeros(self.PLACES, np.uint64), np.zeros(self.PLACES, np.int32)
        self.size = self.used = 0
        self.at, self.count, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        mask = self.PLACES - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        key = self.keys[place]
        out = np.where(key == hashes, self.number[place], -1)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & mask
            key = self.keys[place[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.number[place[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = self.PLACES - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[place] == 0
            taken, one = np.unique(place[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.keys[taken], self.number[taken] = hashes[won], numbers[won]
            rest = np.ones(len(hashes), bool)
            rest[won] = False
            hashes, numbers, place = hashes[rest], numbers[rest], (place[rest] + 1) & mask

    def _encode_plain(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number for each of some plain pieces: joined by blanks, they stay apart."""
        size = ends - starts
        to = np.r_[0, np.cumsum(size + 1)]
        text = np.full(to[-1], 0x20, np.uint8)
        text[np.repeat(to[:-1] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] = part[np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
        ids, count = [], []
        for lo in range(0, len(starts), self.JOINED):
            hi = min(lo + self.JOINED, len(starts))
            e = self.tokenizer.encode(text[to[lo] : to[hi]].tobytes().decode(), add_special_tokens=False)
            owner = np.array(e.word_ids, np.int64)
            n = np.bincount(owner, minlength=hi - lo)
            if len(n) != hi - lo or not n.all():
                raise ValueError("the tokenizer splits pieces by another rule")
            ids.append(np.array(e.ids, np.uint32))
            count.append(n)
        return np.concatenate(ids), np.concatenate(count)

    def _learn(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, hashes: np.ndarray) -> None:
        for whole in (False, True):
            at = np.flatnonzero((kinds == _WHOLE) == whole)
            if not len(at):
                continue
            if whole:
                coded = self.tokenizer.encode_batch_fast([part[a:b].tobytes().decode() for a, b in zip(starts[at], ends[at], strict=True)], add_special_tokens=False)
                found = [x.ids for x in coded]
                count = np.array([len(x) for x in found], np.int64)
                ids = np.array([i for x in found for i in x], np.uint32)
            else:
                ids, count = self._encode_plain(part, starts[at], ends[at])
            self.at, self.count, self.flat = self._room(self.at, self.size + len(at)), self._room(self.count, self.size + len(at)), self._room(self.flat, self.used + len(ids))
            self.at[self.size : self.size + len(at)] = self.used + np.r_[0, np.cumsum(count)[:-1]]
            self.count[self.size : self.size + len(at)] = count
            self.flat[self.used : self.used + len(ids)] = ids
            self._insert(hashes[at], np.arange(self.size, self.size + len(at), dtype=np.int32))
            self.size, self.used = self.size + len(at), self.used + len(ids)

    def ids(self, part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and each text's first place among them (with the end)."""
        starts, ends, kinds = pieces(part, cuts)
        hashes = np.maximum(hash_spans(part, starts, ends), np.uint64(1))
        number = self._find(hashes)
        if len(new := np.flatnonzero(number < 0)):
            _, one = np.unique(hashes[new], return_index=True)
            if self.size + len(one) > self.PLACES * 2 // 5 and self.size:
                self._clear()
                new = np.arange(len(hashes))
                _, one = np.unique(hashes, return_index=True)
            while self.size + len(one) > self.PLACES * 3 // 5:  # one very long text with more pieces than that
                self.PLACES *= 2
                self._clear()
            first = new[one]
            self._learn(part, starts[first], ends[first], kinds[first], hashes[first])
            number = self._find(hashes)
        count, at = self.count[number], self.at[number]
        begin = np.r_[0, np.cumsum(count, dtype=np.int64)]
        take = np.repeat(at - begin[:-1], count) + np.arange(begin[-1])
        return self.flat[take], begin[np.searchsorted(starts, cuts)]


_CODERS: dict[str, PieceIds] = {}


def coder_of(file: str) -> PieceIds:
    """The worker's coder of a tokenizer file; what it knows outlives a task."""
    if file not in _CODERS:
        _CODERS[file] = PieceIds(file)
    return _CODERS[file]


def coded_blocks(column: pa.Array, coder: PieceIds) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, end row, all their ids, and the place where each row's begin (with the end)."""
    release_memory()
    buf, offsets = lowered(column)
    for lo, hi in row_blocks(offsets):
        yield lo, hi, *coder.ids(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _pieces(file: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(file)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            ids_of = batch.column("doc_id").to_pylist()
            for lo, hi, ids, begin in coded_blocks(batch.column("text"), coder):
                for r in range(hi - lo):
                    own = np.append(ids[begin[r] : begin[r + 1]], np.uint32(0)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), limit)):
                        some = own[at : at + limit]
                        doc.append(ids_of[lo + r])
                        piece.append(k)
                        start.append(at)
                        length.append(len(some))
                        crc.append(zlib.crc32(some))
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# --- packing one shard -------------------------------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, limit: int) -> int:
    """No packing has fewer bins: the volume bound, raised by pieces too large to share a bin with others."""
    lengths = np.sort(lengths)
    total = np.r_[0, np.cumsum(lengths)]
    best = -(-int(total[-1]) // limit)
    for k in np.unique(lengths[lengths <= limit // 2]).tolist() if len(lengths) else []:
        large, half, small = (int(np.searchsorted(lengths, x, side="right")) for x in (limit - k, limit // 2, k - 1))
        alone, big = len(lengths) - large, large - half
        free = big * limit - int(total[large] - total[half])
        need = int(total[half] - total[small])
        best = max(best, alone + big + max(0, -(-(need - free) // limit)))
    return best


def best_fit(bins: list[list[int]], loose: list[int], lengths: list[int], limit: int) -> list[list[int]]:
    """Put the pieces, longest first, each into the fullest bin that has room."""
    room = sorted((limit - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(loose, key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (limit - lengths[i], len(bins) - 1))
        else:
            free, k = room.pop(at)
            bins[k].append(i)
            insort(room, (free - lengths[i], k))
    return bins


def swapped(bins: list[list[int]], loose: list[int], lengths: list[int], limit: int) -> list[int]:
    """Exchange loose pieces, longest first, with shorter ones in bins that thereby become fullest; what is loose then.

    Small pieces are easier to place, and every exchange fills a bin further, so this ends.
    """
    items = [(i, k) for k, b in enumerate(bins) for i in b]
    if not items or not loose:
        return loose
    piece, home = (np.array(x) for x in zip(*items, strict=True))
    size = np.array(lengths)[piece]
    room = limit - np.bincount(home, size, len(bins)).astype(np.int64)
    out = []
    for i in sorted(loose, key=lambda i: -lengths[i]):
        left = np.where(size < lengths[i], size + room[home] - lengths[i], -1)
        good = np.flatnonzero(left >= 0)
        if not len(good) or len(fits := np.flatnonzero(room >= lengths[i])) and room[fits].min() - lengths[i] <= left[good].min():
            out.append(i)  # best fit does as well
            continue
        at = good[left[good].argmin()]
        k, gone = int(home[at]), int(piece[at])
        bins[k][bins[k].index(gone)] = i
        room[k] = left[at]
        piece[at], size[at] = i, lengths[i]
        out.append(gone)
    return out


def fitness(bins: list[list[int]], lengths: list[int], limit: int) -> tuple[int, float]:
    """Fewer bins first; then uneven filling, which leaves whole bins to win."""
    return -len(bins), sum((sum(lengths[i] for i in b) / limit) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], limit: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole well-filled bins of ``b`` into ``a``; bins of ``a`` with a duplicate go, their other pieces are best-fitted."""
    fill = np.array([sum(lengths[i] for i in x) / limit for x in b])
    chosen = rng.choice(len(b), size=max(1, len(b) // 3), replace=False, p=fill**4 / (fill**4).sum())
    injected = [list(b[k]) for k in chosen]
    have = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if have.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in have]
    return best_fit(injected + kept, swapped(kept, loose, lengths, limit), lengths, limit)


def mutate(a: list[list[int]], lengths: list[int], limit: int, rng: np.random.Generator) -> list[list[int]]:
    """Take the emptiest bins and a few others apart, and best-fit their pieces in a shaken order."""
    order = np.argsort([sum(lengths[i] for i in x) for x in a])
    gone = set(order[: max(1, len(a) // 20)].tolist()) | set(rng.choice(len(a), size=max(1, len(a) // 20)).tolist())
    loose = [i for k in gone for i in a[k]]
    shaken = {i: lengths[i] for i in loose}
    for i in loose:
        shaken[i] = lengths[i] * (1 + 0.2 * rng.random())
    kept = [list(x) for k, x in enumerate(a) if k not in gone]
    loose = swapped(kept, loose, lengths, limit)
    shaken |= {i: lengths[i] * (1 + 0.2 * rng.random()) for i in loose if i not in shaken}
    room = sorted((limit - sum(lengths[i] for i in x), k) for k, x in enumerate(kept))
    for i in sorted(loose, key=lambda i: -shaken[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            kept.append([i])
            insort(room, (limit - lengths[i], len(kept) - 1))
        else:
            free, k = room.pop(at)
            kept[k].append(i)
            insort(room, (free - lengths[i], k))
    return kept


def evolve(lengths: list[int], limit: int, bound: int, seed: int, elites: list[list[list[int]]]) -> list[list[int]]:
    """The best solution of one island's epoch; it ends at once when the bound is met."""
    rng = np.random.default_rng(seed)
    score = lambda s: fitness(s, lengths, limit)
    people = [*elites, best_fit([], list(range(len(lengths))), lengths, limit)]
    best = max(people, key=score)
    if len(best) <= bound:
        return best
    while len(people) < POPULATION:
        people.append(mutate(best, lengths, limit, rng))
    people.sort(key=score, reverse=True)
    for _ in range(CHILDREN):
        i, j = sorted(rng.choice(len(people), size=2, replace=False).tolist())
        child = crossover(people[j], people[i], lengths, limit, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, limit, rng)
        people = sorted([*people, child], key=score, reverse=True)[:POPULATION]
        if len(people[0]) <= bound:
            break
    return people[0]


def _island(limit: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = row["lengths"]
                elites = [_bins(x) for x in row["elites"] or []]
                best = evolve(lengths, limit, row["bound"], hash((row["shard"], row["island"], epoch)) & 0x7FFFFFFF, elites)
                number = [0] * len(lengths)
                for k, b in enumerate(best):
                    for i in b:
                        number[i] = k
                out.append((row["shard"], row["island"], len(best), number))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["shard", "island", "n_bins", "numbers"])

    return run


def _bins(numbers: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return bins


def _bound(limit: int):
    @F.pandas_udf("int")
    def run(lengths):
        return lengths.map(lambda x: lower_bound(np.asarray(x), limit)).astype("int32")

    return run


def _pack(shards: DataFrame, limit: int, ws: Workspace, name: str) -> DataFrame:
    """``shards(shard, lengths)`` -> (shard, n_bins, numbers): a bin for every place of ``lengths``."""
    shards = ws.save(shards.withColumn("bound", _bound(limit)("lengths")), f"{name}-shards")
    tasks = max(1, min(4096, ISLANDS * shards.count()))  # a number given keeps small partitions apart
    islands = shards.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    best = None
    for epoch in range(EPOCHS):
        if best is None:
            open_ = islands.withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:
            migrants = best.groupBy("shard").agg(F.collect_list(F.struct("island", "numbers")).alias("all"), F.min("n_bins").alias("least"))
            # an island starts from its own best solution and that of its neighbour
            open_ = islands.join(migrants, "shard").filter("least > bound").withColumn("elites", F.expr(f"transform(filter(all, x -> x.island = island or x.island = (island + {ISLANDS - 1}) % {ISLANDS}), x -> x.numbers)")).drop("all", "least")
        done = ws.save(open_.repartition(tasks, "shard", "island").mapInArrow(_island(limit, epoch), "shard long, island int, n_bins int, numbers array<int>"), f"{name}-epoch{epoch}")
        if best is not None:
            done = best.unionByName(done)
        best = done
    return best.groupBy("shard").agg(F.min_by(F.struct("n_bins", "numbers"), F.struct("n_bins", "island")).alias("s")).select("shard", "s.*")


def pack_documents(docs: DataFrame, tokenizer_file: str, limit: int = 2048, shard_pieces: int = SHARD_PIECES, ws: Workspace | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids (no special tokens; such strings in a text are ordinary text) and a closing id 0,
    so a null or empty text is one piece of one id.  Only documents of more than ``limit`` ids are cut.  Sequences
    hold at most ``limit`` ids, without gaps.  Repeated rows are packed as often as they stand there, and a null
    ``doc_id`` is carried along.  Other columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "packing")
    pieces = ws.save(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_file, limit), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    full = pieces.filter(f"length = {limit}")
    rest = pieces.filter(f"length < {limit}")
    n = rest.count()
    first = _packed(rest, max(1, -(-n // shard_pieces)), limit, ws, "first")
    # the worst-filled bins of every shard once more, together
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    poor = ws.save(fill.filter(F.col("fill") < 0.97 * limit).select("sequence_id"), "poor")
    again = ws.save(first.join(poor, "sequence_id", "left_semi"), "loose")
    m = again.count()
    second = _packed(again.drop("sequence_id", "offset"), max(1, -(-m // shard_pieces)), limit, ws, "second") if m else again
    before, after = poor.count(), second.select("sequence_id").distinct().count()
    kept = first.join(poor, "sequence_id", "left_anti")
    done = kept.unionByName(second.withColumn("sequence_id", -F.col("sequence_id") - 1)) if after < before else first
    alone = full.withColumn("sequence_id", (F.lit(1 << 62) + F.monotonically_increasing_id()).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return done.unionByName(alone).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _packed(rest: DataFrame, n_shards: int, limit: int, ws: Workspace, name: str) -> DataFrame:
    place = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.rand(17)), F.lit(n_shards))
    dealt = ws.save(rest.withColumn("shard", place), f"{name}-dealt")
    groups = ws.save(dealt.groupBy("shard").agg(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32")).alias("items")), f"{name}-groups")
    packed = _pack(groups.select("shard", F.col("items.length").alias("lengths")), limit, ws, name)
    rows = groups.join(packed, "shard").select("shard", F.explode(F.arrays_zip("items", "numbers")).alias("x")).select("shard", "x.items.*", F.col("x.numbers").alias("number"))
    rows = rows.withColumn("sequence_id", F.col("shard") * (1 << 24) + F.col("number"))
    from pyspark.sql import Window

    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    return ws.save(out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), f"{name}-rows")
