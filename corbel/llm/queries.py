"""Queries of this subpackage over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.llm.divergence import source_divergence
from corbel.llm.exact import exact_duplicates
from corbel.llm.interactions import audit_filters
from corbel.llm.jaccard import jaccard_components
from corbel.llm.leaks import scan_leaks
from corbel.llm.licences import scan_licences
from corbel.llm.packing import pack_documents
from corbel.llm.pii import find_pii
from corbel.llm.preferences import degraded, format_preferences, siblings
from corbel.llm.quality import score_quality
from corbel.llm.rollups import TokenRollup, corpus_changes
from corbel.llm.secrets import scan_secrets
from corbel.llm.vectors import near_vectors
from corbel.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL["op2_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
    FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), edge AS (
    SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


SQL["op7_decontamination"] = r"""
WITH norm AS (
    SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
    SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM norm
), item AS (
    SELECT DISTINCT id AS item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
    FROM w, unnest(range(1, greatest(len(ws) - 8, 2))) AS t(i) WHERE kind = 1 AND len(ws) > 0
), doc AS (
    SELECT id AS doc_id, k.k, i, array_to_string(ws[i:i + k.k - 1], ' ') AS g
    FROM w, (SELECT DISTINCT k FROM item) k, unnest(range(1, len(ws) - k.k + 2)) AS t(i) WHERE kind = 0
), hit AS (
    SELECT doc_id, doc.k, i, item_id FROM doc JOIN item ON doc.g = item.g AND doc.k = item.k
), n AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, i FROM hit) h, unnest(range(i, i + k)) AS t(p) GROUP BY 1
), its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1
)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE kind = 0
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


@query
def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL["op10_embedding_neardup"] = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), edge AS (
    SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
    SELECT vec_id, vec_id AS other FROM v
    UNION
    SELECT r.vec_id, e.b FROM reach r JOIN edge e ON e.a = r.other
), c AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT v.vec_id, (SELECT count(*) FROM edge WHERE edge.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id)
"""


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = TokenRollup(spark, Workspace(spark, "rollup").root)
    changes = corpus_changes(table(spark, sf_dir, "documents"))
    for batch, rows in [*changes.items(), ("load", changes["load"])]:  # the replay commits nothing
        rollup.apply(batch, rows)
    return rollup.totals()


SQL["op3_token_counts"] = r"""
WITH d AS (
    SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents
), c AS (
    SELECT *, doc_id > min(doc_id) OVER (PARTITION BY text) AS copy,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS blank1,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[A-Za-z0-9\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*')) AS blank2,
           len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+')) AS runs
    FROM d
), k AS (
    SELECT source, lang, 'blank-1' AS tokenizer, blank2 AS n FROM c WHERE NOT copy UNION ALL SELECT source, lang, 'runs-1', runs FROM c WHERE NOT copy
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM k GROUP BY 1, 2, 3
"""


@query
def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    both, pairs = degraded(turns)
    out = format_preferences(both, pairs.unionByName(siblings(turns)))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


SQL["op8_preferences"] = r"""
WITH ends AS (
    SELECT conv_id, max(turn) AS last, min(turn) AS first, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'assistant' GROUP BY 1
), turns AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL
    SELECT -conv_id - 1, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN CASE WHEN first < last THEN first_text ELSE 'I cannot help with that.' END ELSE text END
    FROM conversations JOIN ends USING (conv_id)
), opening AS (
    SELECT conv_id, arg_min(role || chr(10) || text, turn) AS o FROM conversations GROUP BY 1
), pairs AS (
    SELECT conv_id AS chosen_id, -conv_id - 1 AS rejected_id FROM ends
    UNION ALL
    SELECT m, conv_id FROM (SELECT conv_id, min(conv_id) OVER (PARTITION BY o) AS m FROM opening) WHERE conv_id > m
), t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line FROM turns
), pairwise AS (
    SELECT chosen_id, rejected_id, c.i, c.role = r.role AND c.text = r.text AS same
    FROM pairs JOIN t c ON c.conv_id = chosen_id LEFT JOIN t r ON r.conv_id = rejected_id AND r.i = c.i
), n AS (
    SELECT chosen_id, rejected_id, count(*) FILTER (WHERE ok) AS n
    FROM (SELECT *, bool_and(coalesce(same, false)) OVER (PARTITION BY chosen_id, rejected_id ORDER BY i) AS ok FROM pairwise) GROUP BY 1, 2
), side AS (
    SELECT chosen_id, rejected_id, n, true AS chosen, t.* FROM n JOIN t ON conv_id = chosen_id
    UNION ALL
    SELECT chosen_id, rejected_id, n, false, t.* FROM n JOIN t ON conv_id = rejected_id
), placed AS (
    SELECT *, sum(CASE WHEN i > n THEN length(line) ELSE 0 END) OVER (PARTITION BY chosen_id, rejected_id, chosen ORDER BY i) AS done FROM side
)
SELECT chosen_id, rejected_id, CAST(any_value(n) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE chosen AND i <= n), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE chosen AND i > n), '') AS chosen,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE NOT chosen AND i > n), '') AS rejected,
       coalesce(string_agg(CAST(done - length(text) - 9 AS BIGINT) || ':' || CAST(done AS BIGINT), ',' ORDER BY i) FILTER (WHERE chosen AND i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(done - length(text) - 9 AS BIGINT) || ':' || CAST(done AS BIGINT), ',' ORDER BY i) FILTER (WHERE NOT chosen AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY 1, 2
"""


def placed(docs: DataFrame) -> DataFrame:
    """Documents as files: source/language/shelf of 64 ids; the first id of a shelf is the shelf's NOTICE."""
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("NOTICE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.lit("b"), F.floor(F.col("doc_id") / 64).cast("string")), name))


@query
def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(placed(table(spark, sf_dir, "documents")).select("doc_id", "path", "text"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(placed(table(spark, sf_dir, "documents")))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL["op11_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept, text_sha256
FROM d
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = r"""
WITH t AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
    SELECT doc_id, part, len(ws) < 200 AS fa, 100 * len(list_distinct(ws)) < 50 * len(ws) AS fb, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS fc,
           regexp_matches(text, '[#$%&*|]') AS fd, doc_id > min(doc_id) OVER (PARTITION BY text) AS fe
    FROM t
), cell AS (
    SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
    FROM f LEFT JOIN labels USING (doc_id) GROUP BY 1, 2
), l AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)
), o AS (
    SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, unnest(range(1, 6)) AS u(step)
), counted AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
    FROM cell, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL["op13_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
), g AS (
    SELECT DISTINCT lang, source FROM d
), held AS (
    SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS n FROM held GROUP BY 1, 2 HAVING count(*) >= 10
), c AS (
    SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, k.n AS n_lang
    FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM held GROUP BY 1, 2, 3) h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), pq AS (
    SELECT lang, source, term, n,
           CAST(1 + (1000000000::HUGEINT * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS BIGINT) AS p,
           CAST(1 + (1000000000::HUGEINT * (n_lang + 2)::HUGEINT) // (sum(n_lang) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS BIGINT) AS q
    FROM c
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM pq x JOIN pq y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) v
    ON v.lang = a.lang AND v.source = a.source AND v.other = b.source
), r AS (
    SELECT lang, source, part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM pq WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
