"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters.

The plan, all of it over every document:

1. One pass hashes each text's word 5-grams, and gives its set size and a key of the whole set, so equal
   sets form a class at once.  The same pass counts 5-grams that repeat within a task into a table of
   ``SKETCH`` counters, summed by Spark.  Any total order makes prefix filtering exact; ordering by
   (counter, hash) puts rare 5-grams first, and the table's size never depends on the input.
2. Of each class, the rarest ``n - ceil(t n) + 1`` 5-grams are dealt by 5-gram.  A streaming pass over the
   sorted partitions (constant memory whatever a group's size) drops those that only one class has, ranks
   the others' holders, and names the first as hub.
3. The star round verifies (hub, holder) pairs: as many as there are postings, however large the group.
4. 5-grams whose holders are still in several components go to the block round.  Classes of one hub are dealt to
   blocks of bounded size; a class is sent to a block that it shares such a 5-gram with, and there compared with all
   of the block at once.  So each pair of classes is tried or already connected, but no row is made for a pair.
5. Length and positional filters act before sets are sent, the suffix filter before a hub's set is intersected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.llm.components import connected_components
from corbel.llm.wordhash import BLANK_WORDS, mix, window_hashes, words_by_row
from corbel.workspace import Workspace

#: Counters of the order table, a power of two (4 MB when broadcast).
SKETCH = 1 << 20
#: 5-grams that a task gathers before it counts repeats among them.
GATHER = 4_000_000
#: At most so many rows (two or three numbers each, some 10 MB as a hash table) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Texts are joined with the groups that want them by broadcast while those are at most so many rows (50 MB); beyond that,
#: texts that a bitmap of wanted ids leaves are shuffled.
WANTED_ROWS = 500_000
#: Bits of that bitmap (8 MB whatever the input), and of a part that one task fills.
WANTED_BITS = 1 << 26
PART_BITS = 1 << 20
#: 5-grams of a block, and members that one task compares with a block.
BLOCK_GRAMS = 40_000
BLOCK_MEMBERS = 5_000
#: Bytes of each hash that are sent for verification.
SENT_BYTES = 6
#: A 5-gram whose counter exceeds this is dealt over several salted groups, each with its own hub.
HOT = 50_000


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words make one run; none, none."""
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)


def set_key(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _repeats(parts: list[np.ndarray]) -> pa.RecordBatch | None:
    if not parts:
        return None
    grams, counts = np.unique(np.concatenate(parts), return_counts=True)
    grams, counts = grams[counts > 1], counts[counts > 1]
    slots, at = np.unique((grams & np.uint64(SKETCH - 1)).astype(np.int64), return_inverse=True)
    sums = np.bincount(at, weights=counts, minlength=len(slots)).astype(np.int64)
    none = pa.nulls(len(slots), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, pa.array(slots), pa.array(sums)], names=["doc_id", "n", "cls", "slot", "hits"])


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i, _, _, _, words in words_by_row(batch.column("text"), BLANK_WORDS):
                if len(grams := shingles(words, width)):
                    n[i], cls[i] = len(grams), (key := set_key(grams))
                    if key not in seen:
                        seen.add(key)
                        parts.append(grams)
                        held += len(grams)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(cls, pa.int64()), none, none], names=["doc_id", "n", "cls", "slot", "hits"])
            if held >= GATHER:
                yield _repeats(parts)
                parts, held = [], 0
        if (last := _repeats(parts)) is not None:
            yield last

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots and hits of a batch as two byte strings."""
    for batch in batches:
        slot, hits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "hits"))
        yield pa.RecordBatch.from_arrays([pa.array([slot.astype("<i4").tobytes()]), pa.array([np.minimum(hits, 2**31 - 1).astype("<i4").tobytes()])], names=["slot", "hits"])


def least_share(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set it links to."""
    return -(-percent * n // 100)


def _prefixes(width: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = order.value, set()
        for batch in batches:
            out: list[tuple] = []
            for _, _, _, _, words in words_by_row(batch.column("text"), BLANK_WORDS):
                grams = shingles(words, width)
                if not len(grams) or (key := set_key(grams)) in seen:
                    continue
                seen.add(key)
                n, often = len(grams), counters[(grams & np.uint64(SKETCH - 1)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[: n - least_share(n, percent) + 1]
                out.append((grams[first].view(np.int64), np.full(len(first), key), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32), often[first] // HOT))
            if out:
                gram, cls, n, pos, more = (np.concatenate(x) for x in zip(*out, strict=True))
                # 0 is for 5-grams that are not salted, so that _holders can tell a salted one by any of its groups
                salt = np.where(more > 0, (cls & np.int64(0x7FFFFFFF)) % (more + 1) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(salt), pa.array(cls), pa.array(n), pa.array(pos)], names=["gram", "salt", "cls", "n", "pos"])

    return run


_POSTING = "gram long, salt int, cls long, n int, pos int"


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (gram, salt, cls): those in groups of several classes, or salted, with rank and hub."""
    names = ["gram", "salt", "cls", "n", "pos"]
    run = hub = last = None  # of the group that the next batch may continue: its key, first row, last class
    rank, pending = -1, False  # rank of its last class; whether its only row is not yet given out
    for batch in batches:
        col = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        if not len(col[0]):
            continue
        gram, salt, cls, n, pos = col
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
        same = np.zeros(len(gram), bool)
        same[1:] = ~new[1:] & (cls[1:] == cls[:-1])
        if run == (gram[0], salt[0]):
            new[0], same[0] = False, cls[0] == last
        keep = ~same  # one row for each class of a group
        step = np.cumsum(keep)
        start = np.flatnonzero(new)
        base = np.zeros(len(gram), np.int64)
        group = np.cumsum(new)  # 0: the group begun before this batch
        if len(start):
            base[group > 0] = (step[start] - 1)[group[group > 0] - 1]
        ranks = step - 1 - base
        ranks[group == 0] = step[group == 0] + rank
        head = {k: np.empty(len(gram), v.dtype) for k, v in (("cls", cls), ("n", n), ("pos", pos))}
        for k, v in (("cls", cls), ("n", n), ("pos", pos)):
            if len(start):
                head[k][group > 0] = v[start][group[group > 0] - 1]
            if hub is not None:
                head[k][group == 0] = hub[k]
        # groups that end here with one class only are left out, but a salted gram may have other groups
        size = np.bincount(group[keep], minlength=group[-1] + 1)
        many = size[group] > 1
        many[group == 0] = rank + 1 + size[0] > 1
        many |= salt > 0
        out = keep & many
        first_out = None
        if pending and group[0] == 0 and rank + 1 + size[0] > 1:
            first_out, pending = (*run, hub["cls"], hub["n"], hub["pos"], 0, hub["cls"], hub["n"], hub["pos"]), False
        # what the next batch needs
        end = group[-1]
        if end > 0:
            i = start[end - 1]
            run, hub = (gram[i], salt[i]), {"cls": cls[i], "n": n[i], "pos": pos[i]}
            pending = not many[-1]
        rank, last = int(ranks[-1]), cls[-1]
        arrays = [gram[out], salt[out], cls[out], n[out], pos[out], ranks[out].astype(np.int64), head["cls"][out], head["n"][out], head["pos"][out]]
        if first_out is not None:
            arrays = [np.concatenate([np.array([x], a.dtype), a]) for x, a in zip(first_out, arrays, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[*names, "rank", "hub", "hub_n", "hub_pos"])


def _passes(percent: int, n1: str, p1: str, n2: str, p2: str) -> str:
    """The length filter, and the positional one for the first prefix 5-gram that both have."""
    alpha = f"ceil({percent} * ({n1} + {n2}) / {100 + percent}D - 1e-9)"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and least({n1} - {p1}, {n2} - {p2}) >= {alpha}"


def _suffix_apart(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """A lower bound of the size of the symmetric difference, from how pivots split the two sets."""
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b))
    pivot = b[len(b) // 2]
    i, j = np.searchsorted(a, pivot), len(b) // 2
    return _suffix_apart(a[:i], b[:j], depth - 1) + _suffix_apart(a[i:], b[j:], depth - 1)


def _pack(grams: np.ndarray) -> bytes:
    return (grams >> np.uint64(64 - 8 * SENT_BYTES)).view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // SENT_BYTES, 8), np.uint8)
    wide[:, :SENT_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, SENT_BYTES)
    return wide.view(np.uint64).ravel()


class _Block:
    """The sets of some classes, ready to be compared with others."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.cls = np.array([r[0] for r in rows], np.int64)
        self.root = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        grams = np.concatenate([r[2] for r in rows])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], np.repeat(np.arange(len(rows)), self.size)[order]

    def links(self, cls: int, root: int, grams: np.ndarray, percent: int) -> list[int]:
        """Classes of other components that link to the given one, one of each component."""
        total = self.size + len(grams)
        alpha = -(-percent * total // (100 + percent))
        open_ = (self.root != root) & (100 * np.minimum(self.size, len(grams)) >= percent * np.maximum(self.size, len(grams)))
        if not open_.any():
            return []
        if len(self.cls) == 1 and _suffix_apart(self.grams, grams, 3) > total[0] - 2 * alpha[0]:
            return []
        lo, hi = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        count = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.cls))
        good = np.flatnonzero(open_ & (100 * shared >= percent * (total - shared)))
        return self.cls[good[np.unique(self.root[good], return_index=True)[1]]].tolist()


def _match(percent: int):
    """Rows sorted by (group, salt, member): first a group's hubs, then its members; links as (a, b).

    Hubs are compared with each other too, in the first of the salted parts of their group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hubs, block = None, [], None
        found: list[tuple[int, int]] = []

        def close() -> None:
            nonlocal block
            if hubs and block is None:
                block = _Block(hubs)
                if key[1] == 0 and len(hubs) > 1:
                    for cls, root, grams in hubs:
                        found.extend((cls, b) for b in block.links(cls, root, grams, percent))

        def out() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "salt", "member", "cls", "root")]
            sets = batch.column("grams")
            for i, (grp, salt, member, cls, root) in enumerate(zip(*cols, strict=True)):
                if key != (grp, salt):
                    close()
                    key, hubs, block = (grp, salt), [], None
                grams = _unpack(sets[i].as_py())
                if not member:
                    hubs.append((cls, root, grams))
                elif hubs:
                    close()
                    found.extend((cls, b) for b in block.links(cls, root, grams, percent))
            yield out()
        close()
        yield out()

    return run


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint for what was counted and is small; else the table as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _places(ids: pa.Array) -> np.ndarray:
    """The bit of each id; that of a missing one is 0."""
    return (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(WANTED_BITS - 1)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(_places(batch.column("id")))
        yield pa.RecordBatch.from_arrays([pa.array((at // PART_BITS).astype(np.int32)), pa.array((at % PART_BITS).astype(np.int32))], names=["part", "bit"])


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of bits sorted by part: each part as bytes."""
    part, bits = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["part", "bits"])

    for batch in batches:
        parts, at = (batch.column(c).to_numpy() for c in ("part", "bit"))
        for p in np.unique(parts):
            if p != part:
                if part is not None:
                    yield out()
                part, bits = int(p), np.zeros(PART_BITS, bool)
            bits[at[parts == p]] = True
    if part is not None:
        yield out()


def _bitmap(ids: DataFrame):
    """A broadcast bitmap of ``ids(id)``."""
    parts = ids.mapInArrow(_bits, "part int, bit int").repartition("part").sortWithinPartitions("part").mapInArrow(_filled, "part int, bits binary")
    whole = np.zeros(WANTED_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():  # WANTED_BITS / PART_BITS rows
        whole[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole)


def _among(docs: DataFrame, bitmap, inside: bool = True) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` may be in the bitmap (all that are, and few others), or the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column("doc_id").cast(pa.int64()))
            hit = (bitmap.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(hit == inside))

    return docs.mapInArrow(run, docs.schema)


def _send(width: int):
    """A text's packed set, once for each group it is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, to = batch.column("cls").to_pylist(), batch.column("sent").to_pylist()
            out: list[tuple] = []
            for i, _, _, _, words in words_by_row(batch.column("text"), BLANK_WORDS):
                grams = shingles(words, width)
                if len(grams) and set_key(grams) == cls[i]:
                    packed = _pack(grams)
                    out += [(x["grp"], x["salt"], x["member"], cls[i], x["root"], packed) for x in to[i]]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["grp", "salt", "member", "cls", "root", "grams"])

    return run


def _verified(docs: DataFrame, classes: DataFrame, hubs: DataFrame, members: DataFrame, width: int, percent: int, ws: Workspace, name: str) -> DataFrame:
    """Links between ``hubs(grp, cls, root)`` and ``members(grp, cls, root)`` of the same group."""
    members = ws.save(members.select("grp", "cls", "root").distinct(), f"{name}-members")
    parts = members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("parts"))
    hubs = hubs.select("grp", "cls", "root").distinct().join(parts, "grp", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    salted = members.join(parts, "grp").withColumn("salt", F.expr("cast(pmod(xxhash64(cls), parts) as int)")).drop("parts")
    sent = hubs.withColumn("member", F.lit(False)).unionByName(salted.withColumn("member", F.lit(True)))
    by_class = sent.groupBy("cls").agg(F.collect_list(F.struct("grp", "salt", "member", "root")).alias("sent"))
    wanted = ws.save(by_class.join(classes, "cls").select("cls", "least_id", "sent"), f"{name}-wanted")
    small = wanted.agg(F.count("*").alias("n"), F.sum(F.size("sent")).alias("m")).first()
    few = small.n + (small.m or 0) <= WANTED_ROWS
    docs = docs if few else _among(docs, _bitmap(wanted.select(F.col("least_id").alias("id"))))
    # a class all of whose doc_ids are null has a null least_id: the null-safe comparison finds its text
    texts = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["least_id"])).select("cls", "sent", "text")
    rows = texts.mapInArrow(_send(width), "grp long, salt int, member boolean, cls long, root long, grams binary")
    dealt = rows.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "member")
    links = ws.save(dealt.mapInArrow(_match(percent), "a long, b long"), name)
    ws.drop(f"{name}-members", f"{name}-wanted")
    return links


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, ws: Workspace | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Two documents link when their sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; ``component_id`` is the least ``doc_id`` reachable by links, itself included.
    Words are what lies between blanks (0x20, 0x09-0x0D) after folding A-Z.  A text of fewer than ``width``
    words is one shingle; a null, empty or blank text has none and links with nothing.  Repeated rows and
    equal texts fall in one class and link.  A null ``doc_id`` is no candidate for the least.  Other columns
    are ignored.  Shingles and classes are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    told = ws.save(docs.mapInArrow(_describe(width), "doc_id long, n long, cls long, slot long, hits long"), "told")
    info = told.filter("slot is null").select("doc_id", "n", "cls")
    classes = ws.save(info.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n")), "classes")

    links = _links(spark, docs, told, classes, width, percent, ws)
    comp = connected_components(links, ws, "components")
    ids = classes.join(_small(comp.withColumnRenamed("node", "cls")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = ws.save(ids.join(least, "root").select("cls", "component_id"), "by-class")
    ws.drop("classes", "star", "block")
    return info.join(by_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("cls").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the least of its group of linked documents, unchanged.

    Of rows that repeat such an id one stays; rows without an id stay.
    """
    ws = Workspace(docs.sparkSession, "representatives")
    found = jaccard_components(docs, width, percent, ws).filter("doc_id is not null")
    each = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    # most documents stay, so those that do not are what is looked up, and ids that repeat
    odd = ws.save(each.filter("not stays or n > 1").select("doc_id", "stays"), "odd")
    n = odd.agg(F.count("*").alias("n"), F.count_if("stays").alias("repeated")).first()
    clear, doubtful = docs.filter("doc_id is null"), docs.filter("doc_id is not null")
    if n.n > BROADCAST_ROWS:
        # only texts that a bitmap of those ids leaves are shuffled
        bitmap = _bitmap(odd.select(F.col("doc_id").alias("id")))
        clear, doubtful = clear.unionByName(_among(doubtful, bitmap, False)), _among(doubtful, bitmap)
    ids = odd.select("doc_id")
    kept = clear.unionByName(doubtful.join(F.broadcast(ids) if n.n <= BROADCAST_ROWS else ids, "doc_id", "left_anti"))
    if n.repeated:
        kept = kept.unionByName(doubtful.join(odd.filter("stays").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns)


def _links(spark: SparkSession, docs: DataFrame, told: DataFrame, classes: DataFrame, width: int, percent: int, ws: Workspace) -> DataFrame:
    """Verified pairs of classes that connect all classes that links connect."""
    counters = np.zeros(SKETCH, np.int32)
    sums = told.filter("slot is not null").groupBy("slot").agg(F.sum("hits").alias("hits"))
    for r in sums.mapInArrow(_packed, "slot binary, hits binary").toLocalIterator():  # at most SKETCH numbers
        counters[np.frombuffer(r.slot, "<i4")] = np.frombuffer(r.hits, "<i4")
    order = spark.sparkContext.broadcast(counters)

    postings = docs.mapInArrow(_prefixes(width, percent, order), _POSTING)
    dealt = postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "cls")
    held = ws.save(dealt.mapInArrow(_holders, _POSTING + ", rank long, hub long, hub_n int, hub_pos int"), "held")

    star = held.filter("rank > 0").filter(_passes(percent, "n", "pos", "hub_n", "hub_pos"))
    members = star.select(F.col("hub").alias("grp"), "cls", F.col("cls").alias("root"))
    links = _verified(docs, classes, star.select(F.col("hub").alias("grp"), F.col("hub").alias("cls"), F.col("hub").alias("root")), members, width, percent, ws, "star")

    comp = connected_components(links, ws, "stars")
    named = held.join(_small(comp.withColumnRenamed("node", "cls")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    spread = named.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    spread = ws.save(spread.select("gram"), "spread")
    open_ = ws.save(named.join(_small(spread), "gram", "left_semi").select("gram", "cls", "n", "pos", "root", "hub"), "open")
    # a class's home: the block of its least hub that its key picks
    home = open_.groupBy("cls").agg(F.min("hub").alias("home"), F.first("n").alias("n"))
    blocks = home.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("parts"))
    home = ws.save(home.join(blocks, "home").select("cls", F.expr("xxhash64(home, pmod(xxhash64(cls, 1), parts))").alias("grp")), "home")
    placed = ws.save(open_.join(_small(home), "cls"), "placed")
    held_by = placed.groupBy("gram", "grp").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("root").alias("x"), F.max("root").alias("y"))
    one = placed.withColumnRenamed("grp", "own").join(held_by, "gram").filter("own >= grp and not (x = y and x = root)")
    # the length and positional filters, true for a member when they are for any hub of the block
    near = one.filter(f"100 * n >= {percent} * n_min and 100 * n_max >= {percent} * n and least(n - pos, rest) >= ceil({percent} * (n + greatest(n_min, n * {percent} / 100D)) / {100 + percent}D - 1e-9)")
    near = ws.save(near.select("own", "grp", "cls", "root").distinct(), "near")
    # classes of one block meet there as hubs; only those of other blocks are sent besides
    members = near.filter("own <> grp")
    hubs = placed.select("grp", "cls", "root").distinct().join(near.select("grp").distinct(), "grp", "left_semi")
    more = _verified(docs, classes, hubs, members, width, percent, ws, "block")
    ws.drop("held", "spread", "open", "home", "placed", "near")
    return links.unionByName(more)
