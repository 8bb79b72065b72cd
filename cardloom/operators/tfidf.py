"""TF-IDF as DataFrame jobs: vocabulary, weights, vectors.

Weights are in long form, one row per document and term, or packed, one row per document.
Grams are counted block by block (``grams``). For the vocabulary the text is read where it
lies; for the weights it is dealt into chunks by document id. A chunk's distinct terms travel
to the vocabulary and back, its postings do not. Where model and weights are of one corpus,
its words are numbered first and grams travel as numbers, those of rare words not at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.words import spaced_words
from cardloom.operators.grams import (
    Coding,
    chunk_grams,
    chunk_terms,
    chunk_weights,
    coded_frequencies,
    coded_weights,
    frequencies,
    numbered_words,
    packed_runs,
    renumbered,
)
from cardloom.operators.joins import small_side, table_bytes
from cardloom.operators.ranking import with_row_index
from cardloom.session import settle, stored

# Text of a chunk of documents, which one task weighs at once (about 100 MB in
# memory), and the least that is worth a task.
CHUNK_BYTES, LEAST_BYTES = 4 << 20, 1 << 20


@dataclass(frozen=True)
class TfidfConfig:
    # The defaults of the workload; a vocabulary cap only where asked for.
    min_df: int | float = 3
    max_df: int | float = 0.90
    ngram_range: tuple[int, int] = (1, 2)
    max_features: int | None = None
    sublinear_tf: bool = True
    lowercase: bool = True


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary ``(term, term_idx, df, corpus_tf, idf)``."""

    vocabulary: DataFrame
    n_docs: int
    n_terms: int
    config: TfidfConfig = field(default_factory=TfidfConfig)

    def joinable_vocabulary(self) -> DataFrame:
        """The columns that weighting needs, broadcast when their measured size fits."""
        needed = self.vocabulary.select("term", "term_idx", "idf")
        return small_side(needed, table_bytes(needed, text=["term"]))


def _bound(limit: int | float, n_docs: int) -> float:
    """An integer bound is a document count, a fraction a share of the corpus."""
    return limit if isinstance(limit, int) else limit * n_docs


def _chunks(docs: DataFrame, text: str) -> int:
    """Into how many chunks the documents are dealt, by their measured text."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // CHUNK_BYTES), min(cores, size // LEAST_BYTES))


def term_frequencies(
    docs: DataFrame, config: TfidfConfig = TfidfConfig(), text: str = "text"
) -> DataFrame:
    """Document frequency and corpus frequency per term.

    Counted block by block in every task, so that a term costs one row per block, and
    summed by term in the one shuffle.
    """
    texts = docs.select(spaced_words(F.col(text), config.lowercase).alias("text"))
    blocks = texts.mapInArrow(frequencies(*config.ngram_range, config.lowercase), "term string, df long, corpus_tf long")
    return blocks.groupBy("term").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))


def fit_tfidf(
    docs: DataFrame, config: TfidfConfig = TfidfConfig(), text: str = "text"
) -> TfidfModel:
    """Fit the vocabulary: bounds on document frequency, then the most frequent
    ``max_features`` terms, indexed in term order."""
    n_docs = docs.count()
    counted = term_frequencies(docs, config, text)
    kept, n_terms = _within_bounds(counted, n_docs, config)
    return _model(kept, n_terms, n_docs, config)


def _within_bounds(counted: DataFrame, n_docs: int, config: TfidfConfig) -> tuple[DataFrame, int]:
    low, high = _bound(config.min_df, n_docs), _bound(config.max_df, n_docs)
    kept = settle(counted.filter((F.col("df") >= low) & (F.col("df") <= high)))
    n_terms = kept.count()
    if n_terms == 0:
        raise ValueError("no terms remain within the document frequency bounds")
    return kept, n_terms


def _model(kept: DataFrame, n_terms: int, n_docs: int, config: TfidfConfig, *extra: str) -> TfidfModel:
    """The most frequent terms of those within the bounds, indexed in term order."""
    if config.max_features is not None and n_terms > config.max_features:
        ranked = with_row_index(kept, F.desc("corpus_tf"), F.asc("term"), name="_place")
        kept = ranked.filter(F.col("_place") < config.max_features).drop("_place")
        n_terms = config.max_features
    indexed = with_row_index(kept, "term", name="term_idx")
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    vocabulary = settle(
        indexed.select("term", F.col("term_idx").cast("int"), "df", "corpus_tf", idf.alias("idf"), *extra)
    )
    return TfidfModel(vocabulary, n_docs, n_terms, config)


def tfidf_weights(
    docs: DataFrame, model: TfidfModel, text: str = "text", key: str = "id"
) -> DataFrame:
    """Unit-length rows ``(id, term, term_idx, weight)``; unseen terms are dropped.

    The same function weighs the fitted corpus and new text. Rows of one id are one
    document. Rows leave it by document, in order of term index.
    """
    texts, _ = _dealt(docs, model.config, text, key)
    cutting = (*model.config.ngram_range, model.config.lowercase)
    terms = texts.groupBy("chunk").applyInArrow(chunk_terms(*cutting), "chunk int, term string")
    known = terms.join(model.joinable_vocabulary(), "term").select("chunk", "term", "term_idx", "idf")
    id_type = texts.schema["id"].dataType.simpleString()
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        chunk_weights(*cutting, model.config.sublinear_tf), f"id {id_type}, term string, term_idx int, weight double"
    )


def _dealt(docs: DataFrame, config: TfidfConfig, text: str, key: str) -> tuple[DataFrame, int]:
    """``(chunk, id, text)``, dealt by document id, and the number of chunks."""
    n = _chunks(docs, text)
    chunk = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int").alias("chunk")
    dealt = docs.select(chunk, F.col(key).alias("id"), F.col(text).alias("text")).repartition(n, "chunk")
    return dealt.select("chunk", "id", spaced_words(F.col("text"), config.lowercase).alias("text")), n


def _coded(docs: DataFrame, low: float, config: TfidfConfig, text: str, key: str) -> tuple[DataFrame, DataFrame, Coding, int]:
    """The documents as numbers of words, ``(chunk, id, codes)``, stored; the numbered words
    ``(word, code)``; how grams are numbered; and the number of chunks.

    Texts are cut into words once. Words of fewer than ``low`` documents get no number: no gram
    that holds one is in as many.
    """
    dealt, n = _dealt(docs, config, text, key)
    id_type = dealt.schema["id"].dataType.simpleString()
    texts = stored(dealt.groupBy("chunk").applyInArrow(
        numbered_words(config.lowercase), f"chunk int, id {id_type}, codes array<int>, words array<string>, df array<long>"
    ), "texts")
    listed = texts.filter(F.col("words").isNotNull())
    entry = F.posexplode(F.arrays_zip("words", "df")).alias("place", "w")
    listed = listed.select(F.col("chunk").alias("chunk"), entry).select("chunk", "place", F.col("w.words").alias("word"), "w.df")
    frequent = listed.groupBy("word").agg(F.sum("df").alias("df")).filter(F.col("df") >= low)
    numbered = settle(with_row_index(frequent.select("word"), "word", name="code").select("word", F.col("code").cast("int")))
    coding = Coding(numbered.count(), *config.ngram_range)
    known = listed.join(small_side(numbered, table_bytes(numbered, text=["word"])), "word").select("chunk", "place", "code")
    by_chunk = texts.filter(F.col("codes").isNotNull()).select("chunk", "id", "codes").repartition(n, "chunk").groupBy("chunk")
    coded = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(renumbered, f"chunk int, id {id_type}, codes array<int>")
    return stored(coded, "coded"), numbered, coding, n


def _with_terms(grams: DataFrame, words: DataFrame, coding: Coding) -> DataFrame:
    """``grams`` with the text of each."""
    size = table_bytes(words, text=["word"])
    for place in range(1, coding.high + 1):
        digit = F.expr(coding.digit(place)).cast("int").alias(f"_{place}")
        named = words.select(F.col("code").alias(f"_{place}"), F.col("word").alias(f"_word{place}"))
        grams = grams.select("*", digit).join(small_side(named, size), f"_{place}", "left")
    spelt = F.concat_ws(" ", *[f"_word{place}" for place in range(1, coding.high + 1)])
    return grams.select(spelt.alias("term"), "df", "corpus_tf", "gram")


def fit_transform(
    docs: DataFrame, config: TfidfConfig = TfidfConfig(), text: str = "text", key: str = "id",
    packed: bool = False, keep: bool = True,
) -> tuple[TfidfModel, DataFrame]:
    """Model and weights of one corpus, stored unless they are read once only (``keep``).

    Weights are those of ``tfidf_weights``, or with ``packed`` a row ``(id, indices, weights)``
    per document that has terms, as of ``sparse_rows``.
    """
    n_docs = docs.count()
    coded, words, coding, n = _coded(docs, _bound(config.min_df, n_docs), config, text, key)
    if coding.fits():
        model, weights = _coded_weights(coded, words, coding, n, n_docs, config, packed)
    else:
        model = fit_tfidf(docs, config, text)
        weights = tfidf_weights(docs, model, text, key)
        weights = sparse_rows(weights) if packed else weights
    return model, stored(weights, "weights") if keep else weights


def _coded_weights(
    coded: DataFrame, words: DataFrame, coding: Coding, n: int, n_docs: int, config: TfidfConfig, packed: bool
) -> tuple[TfidfModel, DataFrame]:
    counts = coded.select("codes").mapInArrow(coded_frequencies(coding), "gram long, df long, corpus_tf long")
    counts = counts.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))
    kept, n_terms = _within_bounds(counts, n_docs, config)
    model = _model(_with_terms(kept, words, coding), n_terms, n_docs, config, "gram")
    needed = ["gram", "term_idx", "idf", *([] if packed else ["term"])]
    entries = model.vocabulary.select(*needed)
    entries = small_side(entries, table_bytes(entries, text=[] if packed else ["term"]))
    rows = coded.repartition(n, "chunk").groupBy("chunk")
    known = rows.applyInArrow(chunk_grams(coding), "chunk int, gram long").join(entries, "gram").select("chunk", *needed)
    id_type = coded.schema["id"].dataType.simpleString()
    form = "indices array<int>, weights array<double>" if packed else "term string, term_idx int, weight double"
    weights = rows.cogroup(known.groupBy("chunk")).applyInArrow(
        coded_weights(coding, config.sublinear_tf, packed), f"id {id_type}, {form}"
    )
    return replace(model, vocabulary=model.vocabulary.drop("gram")), weights


def vector_shape(docs: DataFrame, model: TfidfModel) -> DataFrame:
    """Rows and terms of the document-term table."""
    return docs.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "term_count", F.lit(model.n_terms).cast("long")
    )


def sparse_rows(weights: DataFrame) -> DataFrame:
    """One row per document with its term indices, ascending, and their weights."""
    runs = weights.select("id", F.col("term_idx").cast("int"), F.col("weight").cast("double"))
    id_type = weights.schema["id"].dataType.simpleString()
    # Neighbouring rows of a document are one row before the shuffle.
    runs = runs.mapInArrow(packed_runs, f"id {id_type}, indices array<int>, weights array<double>")
    packed = runs.groupBy("id").agg(F.collect_list(F.struct("indices", "weights")).alias("runs"))
    entry = lambda i, w: F.struct(i.alias("term_idx"), w.alias("weight"))
    pairs = F.sort_array(F.flatten(F.transform("runs", lambda r: F.zip_with(r["indices"], r["weights"], entry))))
    several = F.when(F.size("runs") > 1, pairs)
    split = packed.select("id", "runs", several.alias("pairs"))
    return split.select(
        "id",
        F.coalesce(F.transform("pairs", lambda p: p["term_idx"]), F.col("runs")[0]["indices"]).alias("indices"),
        F.coalesce(F.transform("pairs", lambda p: p["weight"]), F.col("runs")[0]["weights"]).alias("weights"),
    )


def long_rows(packed: DataFrame) -> DataFrame:
    """``(id, term_idx, weight)`` of packed rows."""
    return packed.select("id", F.inline(F.arrays_zip(F.col("indices").alias("term_idx"), F.col("weights").alias("weight"))))


def all_rows(ids: DataFrame, weights: DataFrame) -> DataFrame:
    """One row of term indices, ascending, and weights for every id; a document without terms
    has empty arrays. ``weights`` are in long form or packed."""
    packed = weights if "indices" in weights.columns else sparse_rows(weights)
    return ids.select("id").join(packed, "id", "left").select(
        "id",
        F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
    )
