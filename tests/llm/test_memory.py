"""What a Python worker holds while the pipeline's stages learn, predict and pack."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lenswork.llm import common, language, near_duplicates


@pytest.fixture(scope="module")
def batch():
    """One Arrow batch, as large as Spark sends it, of texts of different words."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéñ"))
    texts = [" ".join("".join(x) for x in letters[rng.integers(0, len(letters), (350, 8))]) for _ in range(2000)]
    return pa.RecordBatch.from_pydict({"h": list(range(2000)), "text": texts, "lang": ["aa", "bb"] * 1000})


def peak_mb(f):
    tracemalloc.start()
    try:
        found = f()
        return tracemalloc.get_traced_memory()[1] / 1e6, found
    finally:
        tracemalloc.stop()


def totals(batches, buckets=1 << 16):
    out = {}
    for b in batches:
        for lang, bucket, n in zip(*(c.to_pylist() for c in b.columns)):
            out[lang, bucket] = out.get((lang, bucket), 0) + n
    return out


def test_learning_holds_a_slice_of_a_batch(batch, monkeypatch):
    common.worker_cache("tokens")["kept"] = "chunks of the packing stage"
    monkeypatch.setattr(language, "in_slices", lambda batches: common.in_slices(batches, 1 << 20))
    most, _ = peak_mb(lambda: sum(b.num_rows for b in language._gram_counts([batch], 1 << 16)))
    assert most < 60, most
    assert "tokens" not in common._caches


def test_counts_do_not_depend_on_slices(batch, monkeypatch):
    part = batch.slice(0, 60)
    found = totals(language._gram_counts([part], 1 << 16))
    monkeypatch.setattr(language, "GRAM_CHARS", 20)
    monkeypatch.setattr(language, "in_slices", lambda batches: common.in_slices(batches, 5000))
    assert totals(language._gram_counts([part], 1 << 16)) == found
    plain = {}
    for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
        for w in text.split():
            for x in [*language.grams([w])[1].tolist(), (1 << 16) + language.script_of(w)]:
                plain[lang, x] = plain.get((lang, x), 0) + 1
    assert found == plain


def test_word_scores_in_groups(monkeypatch, batch):
    langs, words = ["aa", "bb", "cc"], " ".join(batch.column(1).slice(0, 300).to_pylist()).split()
    model = language.Model(langs, np.random.default_rng(1).integers(0, 9, (1 << 16, 3)), np.ones((len(language.NAMES) + 1, 3)))
    most, (scores, letters) = peak_mb(lambda: model.word_scores(words))
    assert most < 90, most
    monkeypatch.setattr(language, "GRAM_CHARS", 1 << 40)
    more, (whole, same) = peak_mb(lambda: model.word_scores(words))
    assert most < more / 1.5
    assert np.array_equal(scores, whole) and np.array_equal(letters, same)


def test_counts_of_shingles_do_not_depend_on_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 11}" for j in range(40))) for k in range(50)], "text_hash long, text string").repartition(1)
    h, n = near_duplicates.shingle_counts(rows, 5)
    assert len(h) and n.max() > 1
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    monkeypatch.setattr(near_duplicates, "in_slices", lambda batches: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    again = near_duplicates.shingle_counts(rows, 5)
    assert np.array_equal(h, again[0]) and np.array_equal(n, again[1])
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


@pytest.mark.parametrize("own, kept", [(None, str(16 << 20)), ("1MB", "1MB")])
def test_batches_stay_small_where_the_caller_writes(spark, sf, own, kept):
    import corpus_pipeline

    k = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(k) if own is None else spark.conf.set(k, own)
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        corpus_pipeline.language_stage(spark, docs, sf)
        assert spark.conf.get(k) == kept
    finally:
        spark.conf.unset(k)
