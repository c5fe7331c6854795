"""Token counts by source, language and tokenizer version, maintained by signed deltas in idempotent batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.llm.packing import coded_blocks, coder_of
from corbel.workspace import Workspace

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


class TokenRollup:
    """A folder of Parquet folders with additive deltas, and one marker file for each committed batch.

    ``apply`` reduces a batch of changes to one delta a key, writes it to a folder of its own name that no other writer
    has, and then commits by creating the marker ``log/<batch>`` that names the folder.  A file can be created only once,
    so of several writers of a batch one wins, and a folder that no marker names is never read.  ``compact`` adds the
    committed deltas up into one folder and publishes it by creating the next manifest, ``manifest/<number>``: that folder,
    a table of the names of all batches in it, and what it replaces.  Readers list markers, then read the newest manifest, and
    begin again if another one appeared meanwhile; markers whose batches the manifest holds do not count.  Folders are deleted by
    the compaction after the one that replaced them, so a query that began before still finds them.  A writer lost at any step
    leaves the totals as they were, and a replay does what is missing.  ``apply`` compacts at ``MARKERS`` open markers, which
    bounds what the driver lists and reads.
    """

    #: Open markers at which a commit compacts.
    MARKERS = 200

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.root}/{name}" if name else self.root)
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if not s.getPath().getName().startswith("."))

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> bool:
        """Make a file whole or not at all; false where it exists already."""
        half = self._path(f"half/{uuid.uuid4().hex}")
        stream = self._fs.create(half, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        # a rename onto a file fails where it is atomic; elsewhere the check before it is what there is
        done = not self._fs.exists(target) and self._fs.rename(half, target)
        if not done:
            self._fs.delete(half, False)
        return done

    def _newest(self) -> tuple[int, dict]:
        names = self._names("manifest")
        return (int(names[-1]), json.loads(self._read(f"manifest/{names[-1]}"))) if names else (-1, {"folders": [], "names": [], "replaced": []})

    def _state(self) -> tuple[int, dict, dict[str, str], list[str]]:
        """All of one moment: the newest manifest's number and content, the folders of later batches by marker, and markers without use."""
        for _ in range(100):
            try:
                markers = self._names("log")
                number, kept = self._newest()
                inside = self._recorded(kept, [unquote(m) for m in markers])
                later = {m: self._read(f"log/{m}") for m in markers if unquote(m) not in inside}
                # of markers that another manifest took in, some may have been listed just before they were deleted
                if self._newest()[0] == number:
                    return number, kept, later, [m for m in markers if m not in later]
            except Exception as e:  # noqa: BLE001 - a listed file was deleted by a compaction: look again
                if "FileNotFound" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                    raise
        raise RuntimeError("compactions came too fast to read a state")

    def _recorded(self, kept: dict, batches: list[str]) -> set[str]:
        """Those of a bounded number of batches that a manifest holds already."""
        if not kept["names"] or not batches:
            return set()
        names = self.spark.read.schema("batch string").parquet(*[f"{self.root}/{n}" for n in kept["names"]])
        return {r.batch for r in names.filter(F.col("batch").isin(batches)).collect()}

    def committed(self, batch: str) -> bool:
        _, kept, later, _ = self._state()
        return quote(batch, safe="") in later or bool(self._recorded(kept, [batch]))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes(op, source, lang, tokenizer, tokens, old_tokens)``; false if the batch was there already.

        ``op`` is insert (+1 document, +tokens), delete (-1, -tokens) or revise (0, tokens - old_tokens).  Any other
        ``op`` is an error.  A null count adds nothing; null keys are a group of their own; repeated rows count each; a
        batch without rows commits an empty delta; other columns are ignored.
        """
        if self.committed(batch):
            return False
        tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        bad = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(bad.cast("int"))
        delta = F.when(F.col("op") == "insert", tokens).when(F.col("op") == "delete", -tokens).otherwise(tokens - old)
        sums = changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("d_docs"), F.sum(delta).cast("long").alias("d_tokens"))
        folder = f"data/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.root}/{folder}")
        # a marker made anew for a batch that a compaction took in meanwhile counts for nothing
        done = not self.committed(batch) and self._publish(f"log/{quote(batch, safe='')}", folder)
        if done and len(self._names("log")) >= self.MARKERS:
            self.compact()
        return done

    def _deltas(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.root}/{n}" for n in folders])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches; keys without documents and tokens are left out."""
        _, kept, later, _ = self._state()
        sums = self._deltas([*kept["folders"], *later.values()]).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Add up all deltas into one folder, and put the names of their batches into a table, so that replays still do nothing."""
        number, kept, later, unused = self._state()
        if not later:
            return
        folders = [*kept["folders"], *later.values()]
        data, names = f"data/{uuid.uuid4().hex}", f"names/{uuid.uuid4().hex}"
        sums = self._deltas(folders).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.filter("d_docs <> 0 or d_tokens <> 0").write.parquet(f"{self.root}/{data}")
        new = self.spark.createDataFrame([(unquote(m),) for m in sorted(later)], "batch string")
        old = self.spark.read.schema("batch string").parquet(*[f"{self.root}/{n}" for n in kept["names"]]) if kept["names"] else new.limit(0)
        old.unionByName(new).write.parquet(f"{self.root}/{names}")
        made = {"folders": [data], "names": [names], "replaced": [*folders, *kept["names"]]}
        if self._publish(f"manifest/{number + 1:09d}", json.dumps(made)):
            self._clear(number + 1, [*later, *unused])

    def _clear(self, number: int, markers: list[str]) -> None:
        """Delete markers whose batches manifest ``number`` holds, older manifests, and what those had replaced."""
        for name in self._names("manifest"):
            if int(name) < number:
                for folder in json.loads(self._read(f"manifest/{name}"))["replaced"]:
                    self._fs.delete(self._path(folder), True)
                self._fs.delete(self._path(f"manifest/{name}"), False)
        for marker in markers:
            self._fs.delete(self._path(f"log/{marker}"), False)


#: The tokenizer versions counted by patterns.
PATTERNS = {"blank-1": r"[^\x20\x09-\x0D]+", "blank-2": r"[^\x20\x09-\x0D]*[A-Za-z0-9\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*", "runs-1": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"}


def vocabulary_counts(docs: DataFrame, key: str, files: dict[str, str]) -> DataFrame:
    """``key`` and, for each version of ``files``, the number of tokens that its tokenizer file gives ``text``.

    A file is a blank-dropping vocabulary, as ``packing`` takes them.  Each worker encodes each piece of a word once.
    """
    schema = T.StructType([docs.schema[key], *[T.StructField(v, T.LongType()) for v in files]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(key)]
            for file in files.values():
                cols.append(pa.array(np.concatenate([np.zeros(0, np.int64), *[np.diff(begin) for *_, begin in coded_blocks(batch.column("text"), coder_of(file))]])))
            yield pa.RecordBatch.from_arrays(cols, names=[key, *files])

    return docs.select(key, "text").mapInArrow(run, schema)


def token_counts(docs: DataFrame, versions: tuple[str, ...], files: dict[str, str] | None = None) -> DataFrame:
    """Columns source, lang, text's hash, doc_id, and a count for each version; null text counts 0.

    ``versions`` are those of PATTERNS; ``files`` names further ones, each with its tokenizer file.
    """
    text = F.coalesce("text", F.lit(""))
    counts: dict[str, Column] = {v: F.regexp_count(text, F.lit(PATTERNS[v])).cast("long") for v in versions}
    given = F.struct("doc_id", "source", "lang", F.md5(text).alias("digest"), *[c.alias(v) for v, c in counts.items()]).alias("given")
    if not files:
        return docs.select(given).select("given.*")
    return vocabulary_counts(docs.select(given, "text"), "given", files).select("given.*", *[f"`{v}`" for v in files])


def corpus_changes(docs: DataFrame, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Three batches that a corpus's documents imply, over all of them.

    ``load`` inserts every document's counts by blank-1, runs-1 and the tokenizer ``files`` (by version).  ``copies`` deletes those whose text a lesser
    ``doc_id`` also has (a null id is no lesser one; of rows with equal id and text none is deleted).  ``recount``
    revises blank-1 of what is left to blank-2's rule: words without a letter or digit no longer count.  A null text counts
    as empty, repeated rows count each, other columns are ignored, and an empty table gives empty batches.
    """
    # texts are read and counted once; the batches share the written counts
    counts = Workspace(docs.sparkSession, "counts").save(token_counts(docs, ("blank-1", "blank-2", "runs-1"), files), "counts")
    # the first of each text joins by text and id, so that copies of one text do not meet in one task
    first = counts.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = counts.join(first, ["digest", "doc_id"], "left").withColumn("copy", F.col("doc_id").isNotNull() & F.col("first").isNull())

    def rows(op: str, of: DataFrame, **by_version: tuple) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), new.alias("tokens"), old.alias("old_tokens")) for v, (new, old) in by_version.items()]))
        return of.select(F.lit(op).alias("op"), "source", "lang", each.alias("x")).select("op", "source", "lang", "x.*")

    both = {v: (F.col(v), F.lit(None).cast("long")) for v in ("blank-1", "runs-1", *(files or {}))}
    return {
        "load": rows("insert", counts, **both),
        "copies": rows("delete", marked.filter("copy"), **both),
        "recount": rows("revise", marked.filter("not copy and `blank-1` <> `blank-2`"), **{"blank-1": (F.col("blank-2"), F.col("blank-1"))}),
    }
