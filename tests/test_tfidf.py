"""TF-IDF against a brute-force count in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.functions.words import spaced_words, word_tokens
from cardloom.operators import grams as gram_counts
from cardloom.operators import tfidf
from cardloom.operators.tfidf import (
    TfidfConfig,
    all_rows,
    fit_tfidf,
    fit_transform,
    tfidf_weights,
    vector_shape,
)

DOCS = {
    "a": "The red fox. The red dog",
    "b": "red fox jumps over the dog",
    "c": "THE red fox",
    "d": None,
    "e": "42 x_y x_y éa the",
    "f": "the red fox",
    "g": "zzz",
}


def grams(text, low=1, high=2):
    words = re.findall(r"\b\w+\b", (text or "").lower())
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(docs, min_df=2, max_df=0.9, top=None, high=2):
    counts = {k: Counter(grams(t, 1, high)) for k, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    total = Counter()
    for c in counts.values():
        total.update(c)
    limit = max_df if isinstance(max_df, int) else max_df * len(docs)
    kept = [t for t in df if min_df <= df[t] <= limit]
    if top:
        kept = sorted(kept, key=lambda t: (-total[t], t))[:top]
    kept = sorted(kept)
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    weights = {}
    for key, c in counts.items():
        row = {t: (1 + math.log(c[t])) * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(v * v for v in row.values()))
        weights.update({(key, t): v / norm for t, v in row.items()})
    return kept, df, total, idf, weights


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "id string, text string")


@pytest.mark.parametrize("top,max_df,high", [(None, 0.9, 2), (3, 0.9, 2), (4, 6, 1), (None, 4, 3)])
def test_fit_and_weights(spark, docs, top, max_df, high):
    config = TfidfConfig(min_df=2, max_df=max_df, max_features=top, ngram_range=(1, high))
    model, weights = fit_transform(docs, config)
    kept, df, total, idf, expected = brute(DOCS, 2, max_df, top, high)
    rows = model.vocabulary.orderBy("term_idx").collect()
    assert [r.term for r in rows] == kept
    assert [r.term_idx for r in rows] == list(range(len(kept))) and model.n_terms == len(kept)
    assert all((r.df, r.corpus_tf) == (df[r.term], total[r.term]) for r in rows)
    assert all(r.idf == pytest.approx(idf[r.term]) for r in rows)
    got = {(r.id, r.term): r.weight for r in weights.collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_plain_tf_and_case(spark, docs):
    config = TfidfConfig(min_df=1, sublinear_tf=False, lowercase=False, ngram_range=(1, 1))
    _, weights = fit_transform(docs, config)
    row = {r.term: r.weight for r in weights.filter("id = 'a'").collect()}
    assert "The" in row and row["red"] == pytest.approx(row["red"])
    assert row["The"] / row["dog"] == pytest.approx(
        2 * (math.log(8 / 2) + 1) / (math.log(8 / 3) + 1)
    )


def test_new_text(spark, docs):
    model = fit_tfidf(docs, TfidfConfig(min_df=2))
    new = spark.createDataFrame([(1, "the red moon"), (2, "nothing known")], "k int, body string")
    got = tfidf_weights(new, model, "body", "k").collect()
    assert {(r.id, r.term) for r in got} == {(1, "red"), (1, "the"), (1, "the red")}
    assert sum(r.weight**2 for r in got) == pytest.approx(1.0)


def test_rows_without_terms_stay(spark, docs):
    model, weights = fit_transform(docs, TfidfConfig(min_df=2))
    rows = {r.id: r for r in all_rows(docs, weights).collect()}
    assert rows.keys() == DOCS.keys()
    assert rows["d"].indices == [] and rows["g"].weights == []
    assert rows["a"].indices == sorted(rows["a"].indices)
    assert vector_shape(docs, model).first()[:] == (7, model.n_terms)


def test_nothing_left(spark, docs):
    with pytest.raises(ValueError, match="no terms"):
        fit_tfidf(docs, TfidfConfig(min_df=50))


def test_many_chunks_repeated_and_null_ids(spark, monkeypatch):
    """Chunks weigh their own documents; rows of one id, null too, are one document, and
    no gram spans two of its texts."""
    monkeypatch.setattr(tfidf, "CHUNK_BYTES", 8)
    rows = [("a", "red fox"), ("a", "dog red"), (None, "red dog"), (None, None), ("b", "fox red fox red"), ("c", "")]
    docs = spark.createDataFrame(rows, "id string, text string").repartition(5)
    _, weights = fit_transform(docs, TfidfConfig(min_df=1, max_df=1.0))
    got = {}
    for r in weights.collect():
        got.setdefault(r.id, {})[r.term] = r.weight
    assert {k: sorted(v) for k, v in got.items()} == {
        "a": ["dog", "dog red", "fox", "red", "red fox"], None: ["dog", "red", "red dog"], "b": ["fox", "fox red", "red", "red fox"],
    }
    idf = {t: math.log(7 / (1 + n)) + 1 for t, n in {"red": 4, "dog": 2, "red dog": 1}.items()}
    norm = math.sqrt(sum(v * v for v in idf.values()))
    assert got[None] == pytest.approx({t: v / norm for t, v in idf.items()})
    packed = {r.id: r for r in tfidf.sparse_rows(weights.repartition(7)).collect()}
    assert all(r.indices == sorted(r.indices) and len(r.indices) == len(got[k]) for k, r in packed.items())


def test_postings_are_neither_exploded_nor_sorted(spark, docs):
    model = fit_tfidf(docs, TfidfConfig(min_df=2))
    plan = tfidf_weights(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "Window" not in plan


ODD = [
    "The red_1 fox, THE fox", "éa É ß Σας ΣΑΣ İstanbul", "", None, "don't 3.14 x", "\u0663\u0664 \U0001f600a\u0301b", "a", "b",
    "\x00a\x7fB\u00a0c\u2028d",
]


@pytest.mark.parametrize("lowercase", [True, False])
def test_texts_cut_by_bytes(spark, lowercase):
    """Words cut from bytes in a task are those of the regular expression, for broken UTF-8 too."""
    texts = spark.createDataFrame([(t,) for t in ODD], "t string")
    texts = texts.unionByName(spark.sql("select cast(x'41FF42C3' as string) as t")).coalesce(1)
    rows = texts.select(word_tokens(F.col("t"), lowercase).alias("w"), spaced_words(F.col("t"), lowercase).alias("s")).collect()
    got = gram_counts.cut(pa.array([r.s for r in rows]), lowercase).to_pylist()
    assert got == [r.w for r in rows]
    assert gram_counts.cut(pa.array(["x", "a b", "c"]).slice(1), lowercase).to_pylist() == [["a", "b"], ["c"]]


def test_blocks_of_a_batch_are_bounded(monkeypatch):
    """A batch of many texts is counted a few bytes, or words, at a time."""
    sizes, whole = [], gram_counts._numbered
    monkeypatch.setattr(gram_counts, "_numbered", lambda values: sizes.append(len(values)) or whole(values))
    texts = ["red fox red"] * 50 + ["dog " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = pa.Table.from_batches(gram_counts.frequencies(1, 2, True, block_bytes=40)([batch]))
    assert max(sizes) <= 30 and len(sizes) > 20
    total = found.group_by("term").aggregate([("df", "sum"), ("corpus_tf", "sum")]).to_pylist()
    expected = {"red": (50, 100), "fox": (50, 50), "red fox": (50, 50), "fox red": (50, 50), "dog": (1, 30), "dog dog": (1, 29)}
    assert {r["term"]: (r["df_sum"], r["corpus_tf_sum"]) for r in total} == expected
    sizes.clear()
    coding = gram_counts.Coding(3, 1, 2)
    codes = pa.RecordBatch.from_arrays([pa.array([[0, 1, -1, 0]] * 40)], names=["codes"])
    found = pa.Table.from_batches(gram_counts.coded_frequencies(coding, block_words=8)([codes]))
    assert max(sizes) <= 16 and len(sizes) == 20
    total = found.group_by("gram").aggregate([("df", "sum"), ("corpus_tf", "sum")]).to_pylist()
    assert {r["gram"]: (r["df_sum"], r["corpus_tf_sum"]) for r in total} == {0: (40, 80), 1: (40, 40), coding.first(2) + 1: (40, 40)}


@pytest.mark.parametrize("sizes", [(1, 2), (2, 3)])
def test_packed_rows_and_numbered_grams(spark, monkeypatch, sizes):
    """Packed rows are the long ones by document; grams as numbers and as text give the same."""
    monkeypatch.setattr(tfidf, "CHUNK_BYTES", 20)
    rows = [(i, t) for i, t in enumerate(ODD + list(DOCS.values()))] + [(0, "red fox fox red"), (None, "the red fox"), (None, "the dog")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    config = TfidfConfig(min_df=2, ngram_range=sizes)
    model, weights = fit_transform(docs, config, keep=False)
    _, packed = fit_transform(docs, config, packed=True)
    assert packed.count() == weights.select("id").distinct().count()
    of = lambda df: sorted((r.id or -1, r.term_idx, round(r.weight, 12)) for r in df.collect())
    assert of(tfidf.long_rows(packed)) == of(weights)
    row = lambda df: sorted((r.id or -1, r.indices, np.round(r.weights, 12).tolist()) for r in df.collect())
    assert row(all_rows(docs, packed)) == row(all_rows(docs, weights))
    monkeypatch.setattr(gram_counts.Coding, "fits", lambda self: False)
    other, plain = fit_transform(docs, config)
    assert of(plain) == of(weights) and other.n_terms == model.n_terms
    assert sorted(other.vocabulary.collect()) == sorted(model.vocabulary.collect())
