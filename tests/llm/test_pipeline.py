"""The pipeline on a small corpus with planted cases: every stage's decisions take effect, clean documents stay."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = prose(15)
    texts = {k: prose(rng.randint(30, 120)) for k in range(150)}
    texts |= {200 + k: texts[k] for k in range(5)}  # exact copies
    texts |= {300 + k: texts[10 + k] + " extra" for k in range(5)}  # near copies
    texts |= {400 + k: " ".join(word() + "$$$" for _ in range(60)) for k in range(15)}  # junk
    texts |= {500: f"{prose(60)} {passage} {prose(5)}", 501: f"mail me@x.example.com {prose(40)}", 502: None}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
    clean = set(range(150)) | {500, 501}
    assert clean <= set(seen[0]) and not set(seen[0]) & ({502} | set(range(400, 415)))
    assert set(seen[1]) == clean
    assert set(seen[2]) == clean and passage not in seen[2][500].text and all(seen[2][k].text == texts[k] for k in clean - {500})
    assert "[EMAIL]" in seen[3][501].text and seen[3][501].n_chars == len(seen[3][501].text)
    assert set(seen[4]) == clean and docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_edge_tables(spark, tmp_path):
    """Empty documents, and few rows with repeated ones, nulls and a clashing column."""
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "plain words of a short text that says little but is whole", "en", "s", 60)] * 2 + [(2, None, None, None, None), (None, "another plain text without an id at all in it", "en", "s", 40), (3, "", "en", "s", 0)]
    for name, some in (("empty", []), ("few", rows)):
        root = tmp_path / name
        docs = spark.createDataFrame(some, fields)
        (docs.selectExpr("*", "'x' AS given") if some else docs).write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(root)).collect()
        assert sorted((r.doc_id or 0, r.piece) for r in out) == ([(0, 0), (1, 0)] if some else [])
