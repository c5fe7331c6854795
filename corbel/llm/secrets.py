"""Secret scans by built-in functions only: wide candidates, then a random forest removes false positives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs that may be keys; words before and signs after which any value is a candidate; words that speak against.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
HINTS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private|auth|bearer|credential)"
#: Plain parts of the words above, one of which each of them holds.
HINT_PARTS = ("token", "secret", "passw", "pwd", "api", "access", "private", "auth", "bearer", "credential")
AGAINST = r"(?i)(commit|sha-?[0-9]*|checksum|digest|md5|hash|uuid|build|version|revision|etag|isbn|order|page)"
TEST_PATH = r"(?i)(test|example|sample|fixture|doc|spec)"
#: A value in the word that names it (password=value), and a word after which the next one is a value.
INLINE, NAMES = HINTS + r"""[\w.\]"'`-]*(?:=>|:=|[=:])["'`]*([^\s"'`]+)""", HINTS + r"""[\w.\]"'`-]*(?:=>|:=|[=:])["'`]*$"""
BEHIND = HINTS + r"""[\w.\]"'`-]*$"""
SIGN, EDGES = r"^(=>|:=|[=:])$", r"""^["'`(\[{<]+|["'`)\]}>,;]+$"""
#: Neighbouring words on each side, and the slots that they are hashed to.
NEAR, SLOTS = 3, 12
FEATURES = ("n_chars", "transitions", "digits", "capitals", "marks", "distinct", "dictionary", "hint", "against", "assigned", "quoted", "test_path", "depth", *(f"{side}{k}" for side in ("before_", "after_") for k in range(SLOTS)))
#: Labelled findings that are made up for training when none are given.
TRAIN_ROWS = 5000
#: Words that the most documents have: their letter trigrams are the dictionary, at most 26 ** 3 whatever the corpus.
DICTIONARY_WORDS = 3000
#: Words of made-up findings where the corpus gives none.
WORDS = ("report", "summer", "release", "market", "weather", "garden", "final", "notes", "update", "history")
THRESHOLD = 0.5


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"[\s]+")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, position, candidate, before, after, word) for all that may be a secret.

    That is each run of 16 or more key characters, and each value of any length and alphabet that a word such as token or
    password is followed by, with a sign of assignment between, in one word or in two or three.  A run inside such a value
    is no candidate besides.  ``position`` counts blank-separated words from 0; ``before`` and ``after`` hold up to three
    words; ``word`` is the blank-separated word that the candidate stands in.
    """
    # signs and lengths are looked at before patterns, which cost far more and can't match without them
    signed = lambda x: F.contains(x, F.lit("=")) | F.contains(x, F.lit(":"))
    text = F.col("text")
    hinted = reduce(or_, [F.contains(F.lower(text), F.lit(x)) for x in HINT_PARTS])
    words = docs.filter(text.rlike(CANDIDATE) | (signed(text) & hinted & text.rlike(HINTS + r"""[\w.\]"'`-]*\s*[=:]"""))).select("doc_id", "path", _words(text).alias("words"))
    at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    named = lambda i: signed(at(i - 1)) & (at(i - 1).rlike(NAMES) | (at(i - 1).rlike(SIGN) & at(i - 2).rlike(BEHIND)))
    some = lambda i: ((F.length(at(i)) >= 16) & at(i).rlike(CANDIDATE)) | (signed(at(i)) & at(i).rlike(INLINE)) | named(i)
    found = F.filter(F.sequence(F.lit(0), F.size("words") - 1), some)
    # only the neighbours go along with a candidate, not the whole text
    near = F.transform(found, lambda i: F.struct(
        i.alias("position"), at(i).alias("word"), F.array_join(F.slice("words", F.greatest(i - NEAR + 1, F.lit(1)), F.least(i, F.lit(NEAR))), " ").alias("before"),
        F.array_join(F.slice("words", i + 2, F.lit(NEAR)), " ").alias("after"), F.when(named(i), F.regexp_replace(at(i), EDGES, "")).otherwise(F.regexp_replace(F.regexp_extract(at(i), INLINE, 2), EDGES, "")).alias("value"),
    ))
    each = words.select("doc_id", "path", F.explode(near).alias("x")).select("doc_id", "path", "x.*")
    runs = F.filter(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), lambda r: ~F.contains("value", r))
    every = F.when(F.col("value") == "", runs).otherwise(F.concat(runs, F.array("value")))
    return each.withColumn("candidate", F.explode(every)).drop("value")


def dictionary_words(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The ``words`` words of 3 to 12 letters that the most documents have; ties in alphabetical order."""
    own = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{3,12}\b"), F.lit(0)))).alias("w"))
    return [r.w for r in own.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words).collect()]


def dictionary_flags(words: list[str]) -> list[int]:
    """Whether each of the 26 ** 3 letter trigrams is in one of ``words``."""
    known = {w[k : k + 3] for w in words for k in range(len(w) - 2)}
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [int(a + b + c in known) for a in letters for b in letters for c in letters]


def _grams(word: Column) -> Column:
    """Letter trigrams; none for fewer than three letters in a row."""
    return F.regexp_extract_all(F.lower(word), F.lit("(?=([a-z]{3}))"), F.lit(1))


def _slots(words: Column) -> Column:
    """Slots of the letters of each word, folded; words without letters have none."""
    letters = F.filter(F.split(F.regexp_replace(F.lower(words), r"[^\p{L} ]", ""), " "), lambda w: w != "")
    return F.transform(letters, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)))


def featured(found: DataFrame, flags: list[int]) -> DataFrame:
    """``found(candidate, before, after, word, path)`` with the columns FEATURES; ``flags`` is the dictionary, a constant of the plan."""
    c, size = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    known = F.from_json(F.lit(str(flags)), "array<int>")
    place = lambda g: ((F.ascii(F.substring(g, 1, 1)) - 97) * 26 + F.ascii(F.substring(g, 2, 1)) - 97) * 26 + F.ascii(F.substring(g, 3, 1)) - 97
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    covered = F.size(F.filter(_grams(c), lambda g: F.get(known, place(g)) == 1))
    change = "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    rows = found.withColumn("lead", F.concat_ws(" ", "before", F.expr("substring_index(word, candidate, 1)"))).withColumns({"slots_b": _slots(F.col("before")), "slots_a": _slots(F.col("after"))})
    return rows.select(
        *found.columns,
        F.least(size, F.lit(200)).cast("double").alias("n_chars"), count(change).alias("transitions"), count("[0-9]").alias("digits"), count("[A-Z]").alias("capitals"), count(r"[^A-Za-z0-9+/_=-]").alias("marks"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64))).alias("distinct"), (covered / size).alias("dictionary"),
        flag(F.col("lead").rlike(HINTS)).alias("hint"), flag(F.col("lead").rlike(AGAINST)).alias("against"),
        flag(F.col("lead").rlike(r"[=:]\W*$")).alias("assigned"), flag(F.col("lead").rlike("[\"'`]$")).alias("quoted"),
        flag(F.col("path").rlike(TEST_PATH)).alias("test_path"), F.coalesce(F.size(F.split("path", "/")), F.lit(0)).cast("double").alias("depth"),
        *[flag(F.array_contains(f"slots_{side[0]}", F.lit(k).cast("long"))).alias(f"{side}{k}") for side in ("before_", "after_") for k in range(SLOTS)],
    )


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS, words: Sequence[str] = WORDS) -> DataFrame:
    """Made-up findings with labels, five kinds of secrets and eight of other things; ``words`` are what prose is made of.

    Secret are assigned keys with and without digits and passwords of any length; not secret are digests, slugs, numbers,
    names and long words anywhere, and prose and placeholders behind the words that secrets stand behind.
    """
    draw = lambda name: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(1 << 20))
    pick = lambda name, xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(draw(name), F.lit(len(xs))).cast("int"))
    prose = F.split(F.lit(" ".join(list(words)[:400] or WORDS)), " ")
    word = lambda k: F.get(prose, F.pmod(draw(f"w{k}"), F.size(prose)).cast("int"))
    hexes, b64 = F.sha1(F.col("id").cast("string")), F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "[+/=]", "x")
    letters = F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "qwrtzuiopy")
    number = F.abs(F.xxhash64("id")).cast("string")
    kind = F.pmod(F.col("id"), F.lit(13))
    password = F.concat(F.initcap(word(7)), pick("mark", ("@", "!", "#", "$", "", "%")), F.substring(number, 1, 4), pick("end", ("", "!", "x", "-Qz")))
    good_bodies = (hexes, b64, F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), F.substring(letters, 1, 28), password)
    bad_bodies = (
        hexes, F.concat_ws("-", word(1), word(2), word(3), F.pmod(draw("n"), F.lit(3000)).cast("string")), F.rpad(number, 18, "7"), F.concat_ws("_", word(4), word(5), word(6), F.lit("v2")),
        F.concat(word(1), word(2), word(3), word(4)), word(1), pick("stub", ("none", "required", "null", "your-password", "os.environ", "changeme", "true", "prompt", "xxxx", "config.token")), F.sha2(number, 256),
    )
    body = F.when(kind == 0, good_bodies[0])
    for k, x in enumerate([*good_bodies[1:], *bad_bodies], 1):
        body = body.when(kind == k, x)
    good = pick("ctx", ("token =", "api_key =", "secret:", "password =", "auth token:", "ACCESS_KEY =", "private key =", "db_password:"))
    bad = pick("neg", ("see commit", "the sha256:", "checksum", "in the", "page", "and", "build", "digest =", "order no", "id ="))
    behind = kind.isin(10, 11)
    before = F.concat_ws(" ", word(8), F.when((kind < 5) | behind, good).otherwise(bad))
    quoted = F.when(F.pmod(draw("q"), F.lit(2)) == 0, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(body)
    path = pick("path", ("src/app/config.py", "docs/readme.md", "tests/data.txt", "deploy/env.sh", "web/index.html"))
    return spark.range(rows).select(body.alias("candidate"), before.alias("before"), F.concat_ws(" ", word(9), word(10), word(11)).alias("after"), quoted.alias("word"), path.alias("path"), (kind < 5).cast("double").alias("label"))


def train_secrets(labelled: DataFrame, flags: list[int], trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    """A forest over FEATURES from ``labelled(candidate, before, after, word, path, label)``."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(labelled, flags)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7).fit(rows)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """``docs(doc_id, path, text)`` -> a row for each candidate: doc_id, position, candidate, before, probability, is_secret.

    ``candidates`` says what is one.  The forest is trained on ``labelled`` findings, by default made-up ones.  A null or
    empty text has no candidates, a null path counts as depth 0; repeated rows are answered each; texts are read whole;
    other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "path", "text")
    words = dictionary_words(docs)
    flags = dictionary_flags(words)
    model = model or train_secrets(labelled if labelled is not None else labelled_findings(docs.sparkSession, words=words or WORDS), flags)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(featured(candidates(docs), flags))
    scored = model.transform(rows)
    p = vector_to_array("probability").getItem(1)
    return scored.select("doc_id", "position", "candidate", "before", F.round(p, 9).alias("probability"), (p >= THRESHOLD).alias("is_secret"))
