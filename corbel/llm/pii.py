"""Personal data: base patterns, and boosted trees that choose among overlapping high-recall candidates."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.llm.boosting import BoostedTrees, platt, sigmoid
from corbel.llm.pii_examples import look_alike, passages, respelt
from corbel.llm.wordhash import release_memory
from corbel.workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
#: The classifier is fitted on about so many candidates, those with the least hashes of the whole corpus.
TRAIN_ROWS = 20_000
#: Written passages of each kind that it is fitted on besides.
PASSAGES = 1_500
#: An added span needs a calibrated probability at which held-out precision reached this, and at least FLOOR.
PRECISION, FLOOR = 0.99, 0.9

Span = tuple[str, int, int]

# --- base spans --------------------------------------------------------------------------------------------------

_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@host, found from each @ so that long runs without one cost nothing."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _TAIL.match(text, at + 1)):
            yield start, m.end()
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [("email", *x) for x in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- candidates and features -------------------------------------------------------------------------------------

_NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20()./_-]{0,3}[0-9]){6,}")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?[.,]\x20?|\x20?[(\[{](?:\.|dot)[)\]}]\x20?|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])", re.I)
_DOT = r"(?:\x20?[(\[{<](?:dot|\.)[)\]}>]\x20?|\x20dot\x20|\x20\.\x20|\.)"
_AT = re.compile(r"\x20?(?:[(\[{<]at[)\]}>]|@)\x20?|\x20at\x20", re.I)
_HOST = re.compile(r"[\w-]++(?:" + _DOT + r"[\w-]++)+", re.I)
_PART = re.compile(r"[\w.%+-]")
#: Words that stand before personal data.
_HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp")}


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """Names, an @ in whatever spelling, and a host; also ``first dot last at``."""

    def walk(at: int) -> int:
        while at > 0 and _PART.match(text, at - 1):
            at -= 1
        return at

    done = 0
    for m in _AT.finditer(text):
        if m.start() >= done and (host := _HOST.match(text, m.end())) and (start := walk(m.start())) < m.start():
            if text[max(0, start - 5) : start].lower() == " dot ":
                first = walk(start - 5)
                start = first if first < start - 5 else start
            yield start, host.end()
            done = host.end()


def candidates(text: str) -> list[Span]:
    """Overlapping spans of any kind that may be personal data, beyond precision."""
    found: set[Span] = {("email", *x) for x in _spelt(text)}
    if _DIGIT.search(text):
        found |= {("ip", *m.span()) for m in _QUAD.finditer(text)}
        for m in _NUMBER.finditer(text):
            n = len(re.sub("[^0-9]", "", m[0]))
            if n <= 15:  # a bracket that nothing closes is the sentence's
                found.add(("phone", m.start() + (m[0][0] == "(" and ")" not in m[0]), m.end()))
            if 12 <= n <= 19:
                start = m.start() + (m[0][0] in "+(")
                found.add(("card", start, m.end()))
    return sorted(found)


#: Common ends of host names; words or signs before a number of another sort; dates and decimals.
_TOPS = frozenset("com org net edu gov info io eu uk de fr es it nl ch at be pl se no fi dk pt ru cn jp br in us ca au".split())
_OTHER = re.compile(r"(?:\b(?:order|invoice|item|isbn|version|build|rev|id|no|nr|part|serial|ref|section|score|costs|about|values|between|on)\W{0,3}|[$€£#=%])$", re.I)
_DATED = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|[0-9]+\.[0-9]+$")


def features(text: str, span: Span) -> list[float]:
    """Format of the span and context around it."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 24) : a].lower(), text[b : b + 1]
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    gaps = [g for g in re.split("[0-9]+", s)[1:-1] if g]
    local, _, host = re.sub(r"[(\[{<]at[)\]}>]|@|\bat\b", "\0", s, count=1, flags=re.I).partition("\0")
    labels = [x for x in re.split(r"[\x20.()\[\]{}<>]+|\bdot\b", host, flags=re.I) if x and x.lower() != "dot"]
    top = labels[-1].lower() if labels else ""
    return [
        float(KINDS.index(kind)), len(s), len(digits), len(groups), max(sizes), min(sizes), float(s[:1] == "+"), float("(" in s),
        s.count("."), s.count("-"), s.count(" "), float(bool(digits) and luhn(digits)), float(all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float("@" in s), float(len(labels)), sum(c.isalpha() for c in s) / max(1, len(s)),
        float(any(h in before for h in _HINTS[kind])), float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "$€£#=\"'" and before != ""),
        float(after in "%\"'" and after != ""), float(len(set(digits))), float(top in _TOPS), float(len(top)), float(bool(re.search(r"[0-9._+-]", local))),
        float(bool(re.search(r"[(\[{<](?:at|dot|\.)[)\]}>]", s, re.I))), float(bool(re.search(r"\bdot\b", s, re.I))), float(sizes[0]), float(sizes[1] if len(sizes) > 1 else 0), float(sizes[-1]),
        float(len(set(gaps))), s.count(","), s.count("/"), float(digits[:1] or -1), float(digits[:2] == "00"), float(bool(_DATED.match(s))), float(bool(_OTHER.search(before))),
        float(labels[0].lower() == "www") if labels else 0.0,
    ]


def _respelt(text: str, span: Span) -> Iterator[tuple[str, Span, int]]:
    """The place of a base span with other values set into it: respelt ones (label 1) and look-alikes (label 0)."""
    kind, a, b = span
    left, right = text[max(0, a - 40) : a], text[b : b + 10]
    rng = random.Random(hashlib.blake2b(f"{a}:{left}{text[a:b]}{right}".encode(errors="replace"), digest_size=8).digest())
    for _ in range(3):
        value = respelt(kind, rng)[0]
        yield f"{left}{value}{right}", (kind, len(left), len(left) + len(value)), 1
        if not any(h in left[-24:].lower() for hints in _HINTS.values() for h in hints):
            value = look_alike(kind, rng)
            yield f"{left}{value}{right}", (kind, len(left), len(left) + len(value)), 0


def _planted(text: str, span: Span, label: int) -> Iterator[tuple[list[float], int]]:
    """Candidates that overlap what was planted: of its kind they have its label (1 only if they miss at most a sign at either end), of others 0."""
    kind, a, b = span
    for found in candidates(text):
        k, x, y = found
        if x < b and a < y:
            yield features(text, found), int(label and k == kind and abs(x - a) <= 1 and abs(y - b) <= 1)


def _examples(text: str) -> Iterator[tuple[list[float], int]]:
    """Candidates on base spans, and what is planted in their places; other candidates have no known label and are left out."""
    base = base_spans(text)
    for span in candidates(text) if base else ():
        kind, a, b = span
        over = {k for k, x, y in base if x < b and a < y}
        if over:  # where a base span of another kind stands, the candidate is of the wrong kind
            yield features(text, span), int(kind in over)
    for span in base:
        for changed, at, label in _respelt(text, span):
            yield from _planted(changed, at, label)


def _texts(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """Values of a column, decoded some rows at a time."""
    release_memory()
    for lo in range(0, len(column), rows):
        yield from column.slice(lo, rows).to_pylist()


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank, xs, ys = [], [], []
        for text in _texts(batch.column("text")):
            for k, (x, y) in enumerate(_examples(text or "")):
                rank.append(hashlib.blake2b(f"{k}:{x}:{text[:64]}:{len(text)}".encode(), digest_size=8).hexdigest())
                xs.append(np.array(x, "<f8").tobytes())
                ys.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(rank, pa.string()), pa.array(xs, pa.binary()), pa.array(ys, pa.int32())], names=["rank", "x", "y"])


@dataclass
class PiiModel:
    trees: BoostedTrees
    slope: float
    shift: float
    thresholds: dict[str, float]
    held_out: dict[str, tuple[float | None, float | None, int]]  # by kind: precision, recall, number of examples

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.trees.score(x) + self.shift)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and those the classifier adds: none overlaps a base span or a better one of its kind."""
        base = base_spans(text)
        taken = [(a, b) for _, a, b in base]
        loose = [s for s in candidates(text) if not any(x < s[2] and s[1] < y for x, y in taken)]
        if not loose:
            return base, []
        p = self.probabilities(np.array([features(text, s) for s in loose]))
        added: list[Span] = []
        for k in np.argsort(-p, kind="stable"):
            kind, a, b = loose[k]
            if p[k] >= self.thresholds[kind] and not any(x < b and a < y for _, x, y in added):
                added.append(loose[k])
        return base, added


def fit_pii(docs: DataFrame, rows: int = TRAIN_ROWS, ws: Workspace | None = None) -> PiiModel:
    """Train on base spans of ``docs``, on values planted in their places, and on ``PASSAGES`` written passages of each kind.

    At most ``rows`` different examples of ``docs`` are used, those with the least hashes; examples of equal texts count
    once.  A quarter is held out for calibration, thresholds and ``held_out``.  A table without base spans leaves the passages.
    """
    ws = ws or Workspace(docs.sparkSession, "pii")
    found = ws.save(docs.select("text").filter("text is not null").mapInArrow(_example_rows, "rank string, x binary, y int"), "examples")
    # ranks are uniform hashes: a bound on them takes about ``rows`` different ones, whatever the number of tasks
    n = found.agg(F.approx_count_distinct("rank")).first()[0]
    some = found.filter(F.col("rank") < f"{int(rows / n * (1 << 64)):016x}") if n > rows else found
    sample = some.dropDuplicates(["rank"]).orderBy("rank").limit(rows).collect()
    own = [e for kind, text, a, b, label in passages(KINDS, PASSAGES) for e in _planted(text, (kind, a, b), label)]
    x = np.concatenate([np.frombuffer(b"".join(r.x for r in sample), "<f8").reshape(len(sample), -1) if sample else np.zeros((0, len(own[0][0]))), np.array([e[0] for e in own])])
    y = np.array([r.y for r in sample] + [e[1] for e in own], float)
    held = np.arange(len(y)) % 4 == 3
    trees = BoostedTrees(trees=80, depth=4).fit(x[~held], y[~held])
    slope, shift = platt(trees.score(x[held]), y[held])
    model = PiiModel(trees, slope, shift, {}, {})
    p = model.probabilities(x[held])
    for k, kind in enumerate(KINDS):
        at = x[held][:, 0] == k
        order = np.argsort(-p[at], kind="stable")
        right = y[held][at][order]
        hits = np.cumsum(right) / np.arange(1, at.sum() + 1)
        good = np.flatnonzero(hits >= PRECISION)
        model.thresholds[kind] = max(FLOOR, float(p[at][order][good[-1]])) if len(good) else 2.0
        chosen = p[at][order] >= model.thresholds[kind]
        model.held_out[kind] = (float(right[chosen].mean()) if chosen.any() else None, float(right[chosen].sum() / right.sum()) if right.any() else None, int(at.sum()))
    return model


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _report(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans, added = {k: [] for k in KINDS}, [], [], []
            for text in _texts(batch.column("text")):
                base, more = shared.value.spans(text or "")
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + more))
                added.append(len(more))
            cols = [batch.column("doc_id").cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def find_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> per row doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    ``spans`` lists base spans and those the classifier adds as kind:start:end in code points, end exclusive.  A null
    or empty text has none.  Repeated rows are reported each.  Other columns are ignored.  ``model`` defaults to one
    fitted on ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_pii(docs))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(_report(shared), schema)


def _redacted(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """The rows of ``docs``, all of them, with every span replaced by its kind in brackets; ``n_chars`` follows the text.

    Of overlapping spans the first (of those that begin together the longest) names the gap, which covers them all.  Rows
    without spans come back unchanged, null and empty texts too; repeated rows stay; an empty table stays empty.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model or fit_pii(docs)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts, sizes = batch.column("text"), [], []
            for lo in range(0, batch.num_rows, 256):
                some, changed = column.slice(lo, 256).to_pylist(), False
                for i, text in enumerate(some):
                    if text:
                        base, more = shared.value.spans(text)
                        if base or more:
                            some[i], changed = _redacted(text, base + more), True
                sizes += [None if x is None else len(x) for x in some]
                texts.append(pa.array(some, column.type) if changed else column.slice(lo, 256))
            release_memory()
            new = {"text": pa.concat_arrays(texts) if texts else column}
            if "n_chars" in names:
                new["n_chars"] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema]))
