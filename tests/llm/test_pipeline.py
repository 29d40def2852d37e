"""The pipeline's stages against plain versions of each."""

import hashlib
from collections import Counter

import brute
import corpus_pipeline
import pytest

from doctide.llm import mixing
from doctide.llm.queries import QUERIES, tokenizer


def test_stages(spark):
    import sentencepiece

    docs = brute.documents(spark).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "mixing", "SentencePiece encoding and decoding"]
    (_, rules), (_, lines), (_, copies), (_, mixture), (_, encoded) = corpus_pipeline.STAGES
    one = rules(spark, docs, "").cache()
    assert one.columns == docs.columns
    kept = {r.doc_id: r.text or "" for r in one.collect()}
    assert all(not brute.quality_signals(t)[-1] for t in kept.values()) and len(kept) > 20
    two = lines(spark, one, "").cache()
    want = brute.line_dedup(kept)
    got = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    assert two.columns == docs.columns and {i: t for i, (t, _) in got.items()} == {i: x[2] for i, x in want.items()}
    assert all(n == len(got[i][0]) for i, (_, n) in got.items() if want[i][1])
    three = copies(spark, two, "").cache()
    classes = brute.ngram_classes({i: t for i, (t, _) in got.items()}, 5, 80)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {c for _, c in classes.values()}
    four = mixture(spark, three, "").cache()
    times = Counter(r.doc_id for r in four.collect())
    assert four.columns == docs.columns and set(times) == {c for _, c in classes.values()} and max(times.values()) <= mixing.MAX_EPOCHS
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for r in encoded(spark, four, "").collect():
        ids = [*model.encode(got[r.doc_id][0]), 2]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_near_copies_by_five_words(spark):
    """Isolated one-word edits that meet five words and 0.8, but not four words and 0.85."""
    rows, want = [], set()
    for k, (length, edits) in enumerate(((100, 2), (150, 3), (200, 4), (100, 3))):
        base = [f"w{k}x{j}" for j in range(length)]
        near = [f"edit{j}" if j % 30 == 15 and j // 30 < edits else w for j, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        want |= {2 * k} if edits * 50 == length else {2 * k, 2 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {c for _, c in brute.ngram_classes(dict(rows)).values()} == set(range(8))
    assert {c for _, c in brute.ngram_classes(dict(rows), 5, 80).values()} == want
    copies = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert {r.doc_id for r in copies(spark, docs, "").collect()} == want


def test_stages_on_an_empty_table(spark):
    docs = brute.documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and "text" in docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_files(spark, tmp_path, name):
    """Each query on small tables whose documents have columns with clashing names."""
    from pyspark.sql import functions as F

    brute.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.range(120).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 7)]).alias("embedding")).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0


def test_suffix_query_on_a_file(spark, tmp_path):
    """The query's columns and rows against the plain version; of a single row, one of the batches is empty."""
    for name, df, texts in (
            ("many", brute.documents(spark), brute.by_id()),
            ("one", spark.createDataFrame([(5, "q" * 250)], "doc_id long, text string"), {5: "q" * 250})):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = QUERIES["op3_suffix_dedup"](spark, str(tmp_path / name))
        assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
        assert sorted(map(tuple, got.collect())) == sorted(brute.suffix_dedup([(i, t.encode()) for i, t in texts.items()]))
