"""The pipeline against its operators, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pairflow.llm import language, quality

from test_operators import plain_components


def test_stages(spark):
    """Each stage against a version without Spark of its own."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "packing"] and corpus_pipeline.ORACLE_SQL is None
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.keep_good(spark, docs, sf).cache()
    scorer = quality.learn(docs, labels)
    assert good.columns == docs.columns and ids(good) == sorted(i for i, t in texts.items() if scorer.scores([t])[0] >= quality.THRESHOLD)
    spoken = corpus_pipeline.keep_languages(spark, good, sf).cache()
    network = language.learn(good).folded()
    found = {i: network.predict([texts[i]]) for i in ids(good)}
    assert spoken.columns == docs.columns and ids(spoken) == sorted(i for i, ((label,), (score,)) in found.items() if label != "und" and score >= language.LEAST_SCORE)
    kept = corpus_pipeline.keep_first_copies(spark, spoken, sf).cache()
    plain = plain_components([(i, texts[i]) for i in ids(spoken)], 80)
    assert kept.columns == docs.columns and ids(kept) == sorted(i for i, (_, first) in plain.items() if i == first)
    packed = corpus_pipeline.pack_sequences(spark, kept, sf)
    assert sorted({r.doc_id for r in packed.select("doc_id").distinct().collect()}) == ids(kept)
    assert len(ids(kept)) < len(ids(spoken)) and len(ids(good)) < len(texts)
    clean = labels.where("quality = 1").join(docs, "doc_id").select("doc_id")
    assert clean.join(spoken, "doc_id", "left_anti").count() <= 0.02 * clean.count()


def test_stages_without_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs, sf).count() == 0


def test_stages_keep_odd_columns_and_rows(spark):
    """Clashing names, nulls, empty and very long texts, ties and repeated rows."""
    sf = "/root/testdata/sf0.001"
    names = ["score", "node", "tie", "_gone_id", "gone_id", "again", "block", "bucket", "length", "offset"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    first = docs.orderBy("doc_id").limit(1)
    odd = first.withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    blank = first.withColumns({"doc_id": F.lit(900_001).cast("bigint"), "text": F.lit(" \n")})
    long = first.withColumns({"doc_id": F.lit(900_002).cast("bigint"), "text": F.repeat(F.concat("text", F.lit("\n")), 400)})
    tied = first.withColumns({"doc_id": F.lit(900_003).cast("bigint")})
    docs = docs.union(odd).union(odd).union(blank).union(long).union(tied).union(docs.limit(3)).select(*columns)
    docs = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [*columns, *names]
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) > 50 and 900_001 not in ids and None not in ids
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, sf).collect()} == set(ids)


def test_run_and_registry(spark):
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in known if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in known
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_language_threshold(spark):
    network = language.train(["the cat and the dog " * 20, "der hund und die katze " * 20], ["en", "de"])
    rows = spark.createDataFrame([(1, "the dog"), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in language.documents_with_language(rows, network).collect()] == [1]


@pytest.mark.parametrize("gone", ["pairflow.llm", "corpus_pipeline"])
def test_entry_without_the_operators(monkeypatch, gone):
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == gone else real(name, *a))
    assert "wordcount" in __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())


def test_near_duplicate_stage_links_from_four_fifths(spark):
    """Against brute force at 0.8: pairs of every likeness from 0.70 to 0.95, a third of them in [0.80, 0.85)."""
    sets, rows = {}, []
    for i in range(240):
        n = 40 + i % 97
        changed = n - round(n * 2 * (0.70 + 0.25 * (i % 24) / 23) / (1.70 + 0.25 * (i % 24) / 23))
        for k in (0, 1):
            words = [f"w{i}x{j}{'y' * k if j >= n + 4 - changed else ''}" for j in range(n + 4)]
            sets[2 * i + k] = {tuple(words[j : j + 5]) for j in range(n)}
            rows.append((2 * i + k, " ".join(words)))
    alike = [len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) for a in range(0, 480, 2)]
    assert sum(0.8 <= x < 0.85 for x in alike) >= 30 and sum(x < 0.8 for x in alike) >= 30
    gone = {a + 1 for a in range(0, 480, 2) if 100 * len(sets[a] & sets[a + 1]) >= 80 * len(sets[a] | sets[a + 1])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.keep_first_copies(spark, docs, None).collect()} == set(sets) - gone
