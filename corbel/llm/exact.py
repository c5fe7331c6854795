"""Exact deduplication: frequent digests are found by a Misra-Gries summary and settled map-side, the rest is shuffled.

Texts are equal when they are identical without white space; their SHA-256 stands for them.  Spark's ``approx_top_k``
keeps a mergeable Misra-Gries summary (counters that are lowered together when they run out), so a digest that holds more
than 3.5 / ``COUNTERS`` of all rows is among its candidates.  One exact aggregation verifies the candidates and names the row
of each that stays; these at most ``WINNERS`` rows are broadcast, and their copies never reach a shuffle.  Every other
group is smaller than that share, and an ordinary shuffle settles it.  All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel.workspace import Workspace

#: Counters of a summary, and the candidates taken from it: every digest above 3.5 / COUNTERS of the rows is among them.
COUNTERS = 4096
WINNERS = 1200
#: Summaries of tasks are first merged in so many groups, then into one.
MERGES = 64
#: White space, U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """A text without white space; null is empty.  Six searches for one byte beat an expression over all of them."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def frequent(digests: DataFrame) -> DataFrame:
    """(code): at most ``WINNERS`` hashes, those of all digests above 3.5 / ``COUNTERS`` of the rows among them."""
    codes = digests.select(F.xxhash64("digest").alias("code"), F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("merge"))
    parts = codes.groupBy("merge").agg(F.expr(f"approx_top_k_accumulate(code, {COUNTERS})").alias("summary"))
    whole = parts.groupBy(F.col("merge") < 0).agg(F.expr(f"approx_top_k_combine(summary, {COUNTERS})").alias("summary"))  # one group, and none without rows
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {WINNERS})")).alias("x")).select(F.col("x.item").alias("code"))


def _first() -> Column:
    """What orders the rows of a group: most characters, least id (null last), then the earlier row."""
    return F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), "id", "row"))


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Of equal texts the row with the most code points stays, then the one with the least id; an id of null comes after all
    others.  Null texts and texts of white space alone equal the empty text.  Of rows that repeat an id and a text, one
    stays.  An empty table gives no rows; other columns are not looked at, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "exact")
    given = F.col(f"`{text}`")
    digests = docs.select(F.col(f"`{id}`").alias("id"), F.unhex(F.sha2(normalised(given), 256)).alias("digest"), F.char_length(F.coalesce(given, F.lit(""))).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    digests = ws.save(digests, "digests")

    candidates = digests.join(F.broadcast(frequent(digests)), F.xxhash64("digest") == F.col("code"))
    winners = candidates.groupBy("digest").agg(F.count("*").alias("group_size"), _first().alias("first")).filter("group_size > 1")
    winners = ws.save(winners, "winners")

    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.withColumns({"group_size": F.count("*").over(group), "first": _first().over(group)})
    rows = hot.unionByName(rest)
    return rows.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and texts as they are.

    Texts are not shuffled: ids that go are joined away.  Where a row is repeated with its id, one of the repeated rows stays.
    """
    decided = exact_duplicates(docs, id, text)
    # one row for each id and text of which a row goes: does another row of that id and text stay?
    going = decided.groupBy(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).agg(F.bool_or("kept").alias("__again"), F.count("*").alias("__n")).filter("not __again or __n > 1").drop("__n")
    going = Workspace(docs.sparkSession, "exact").save(going, "going")
    here = docs.withColumn("__text", F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256)))
    rows = here.join(going, F.col(f"`{id}`").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")), "left")
    once = rows.filter("__again").withColumn("__chars", F.char_length(f"`{text}`"))
    # repeated rows: the longest original text of the id stays
    longest = Window.partitionBy("__id", "__digest").orderBy(F.desc_nulls_last("__chars"))
    once = once.withColumn("__rank", F.row_number().over(longest)).filter("__rank = 1")
    return rows.filter("__again is null").select(*[f"`{c}`" for c in docs.columns]).unionByName(once.select(*[f"`{c}`" for c in docs.columns]))
