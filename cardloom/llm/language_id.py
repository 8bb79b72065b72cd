"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, released

ORDER = 3  # longest context, in bytes
UNKNOWN = "und"
SALTS = 256  # parts in which a language's rows are ranked before they meet


def _symbols() -> np.ndarray:
    """Byte to symbol: letters in lower case, bytes beyond ASCII as they are, the rest 0."""
    table = np.zeros(256, dtype=np.int64)
    for b in range(26):
        table[ord("a") + b] = table[ord("A") + b] = 1 + b
    table[128:] = np.arange(27, 27 + 128)
    return table


SYMBOLS = _symbols()
ALPHABET = int(SYMBOLS.max()) + 1


def _contexts(symbols: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The 1st to ORDER-th symbol before each; 0 before the start of a text."""
    out = []
    for k in range(1, ORDER + 1):
        back = np.zeros_like(symbols)
        back[k:] = symbols[:-k] if k < len(symbols) else 0
        for j in range(k):
            at = offsets[:-1] + j
            back[at[at < offsets[1:]]] = 0
        out.append(back)
    return out


def _gram_counts(batches):
    for batch in released(batches):
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for first, data, offsets in chunks(batch.column(1)):
            symbols = SYMBOLS[data]
            code = symbols.copy()
            for k, back in enumerate(_contexts(symbols, offsets), start=1):
                code += back * ALPHABET**k
            owner = np.repeat(langs[first : first + len(offsets) - 1], np.diff(offsets))
            for lang in sorted(set(owner)):
                grams, counts = np.unique(code[owner == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )


class Model:
    """Frozen code lengths: per context node and symbol, one number per language."""

    def __init__(self, langs: list[str], counts: list[dict[int, int]], least: int):
        self.langs = langs
        seen = sorted({g % ALPHABET for c in counts for g in c} | {0})
        self.alphabet = len(seen) + 1  # the last stands for symbols never seen
        self.symbol = np.full(ALPHABET, len(seen), dtype=np.int64)
        self.symbol[seen] = np.arange(len(seen))
        a, uniform = self.alphabet, math.log2(self.alphabet)
        tables = [self._tree(c) for c in counts]
        nodes: dict[tuple, int] = {(): 0}
        rows = [self._lengths((), tables, np.full((a, len(langs)), uniform))]
        for depth in range(1, ORDER + 1):
            found = {x for t in tables for x, n in t.items() if len(x) == depth and sum(n.values()) >= least}
            for context in sorted(found):
                if context[1:] in nodes:
                    nodes[context] = len(rows)
                    rows.append(self._lengths(context, tables, rows[nodes[context[1:]]]))
        self.lengths = np.array(rows, dtype=np.float32).reshape(len(rows) * a, len(langs))
        self.node = self._lookup(nodes)

    def _tree(self, counts: dict[int, int]) -> dict[tuple, dict[int, int]]:
        """Every context of up to ORDER symbols with the counts of what follows."""
        tree: dict[tuple, dict[int, int]] = {}
        for gram, n in counts.items():
            path = []
            for _ in range(ORDER + 1):
                gram, symbol = divmod(gram, ALPHABET)
                path.append(int(self.symbol[symbol]))
            for depth in range(ORDER + 1):
                context = tuple(reversed(path[1 : depth + 1]))
                node = tree.setdefault(context, {})
                node[path[0]] = node.get(path[0], 0) + n
        return tree

    def _lengths(self, context: tuple, tables: list, shorter: np.ndarray) -> np.ndarray:
        """Bits per symbol: a seen symbol by its share, others by an escape to the shorter
        context. A language that never saw the context uses the shorter one as it is."""
        out = shorter.copy()
        for k, table in enumerate(tables):
            follow = table.get(context)
            if follow:
                total = sum(follow.values()) + len(follow)
                out[:, k] += math.log2(total / len(follow))
                for symbol, n in follow.items():
                    out[symbol, k] = math.log2(total / n)
        return out

    def _lookup(self, nodes: dict[tuple, int]) -> np.ndarray:
        """The node of the longest known suffix for every possible context."""
        a = self.alphabet
        table = np.zeros(1, dtype=np.int32)
        for depth in range(1, ORDER + 1):
            # The nearest symbol is the least digit, so a shorter context is a remainder.
            table = np.tile(table, a)
            for context, node in nodes.items():
                if len(context) == depth:
                    table[sum(s * a**k for k, s in enumerate(reversed(context)))] = node
        return table

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text under every language."""
        symbols = self.symbol[SYMBOLS[data]]
        index = np.zeros_like(symbols)
        space = self.symbol[0]
        for k, back in enumerate(_contexts(symbols - space, offsets)):
            index += (back + space) * self.alphabet**k
        each = self.lengths[self.node[index] * self.alphabet + symbols]
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        some = np.diff(offsets) > 0
        if some.any():
            out[some] = np.add.reduceat(each, offsets[:-1][some], axis=0, dtype=np.float64)
        return out


def fit(
    docs: DataFrame, per_language: int = 1000, least: int = 16
) -> Model:
    """A model from ``docs`` (doc_id, text, lang), rows with text and lang only.

    The bound: the ``per_language`` rows of each language with the smallest hash of doc_id
    and text, whole texts. Contexts seen under ``least`` times are left to shorter ones.
    Counts are summed by Spark; the driver gets the sums of that sample.
    """
    rows = docs.filter("text is not null and lang is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64("doc_id", "text").alias("h"),
    )
    # Ranked twice, so that no task ranks the rows that every partition sends of a language.
    chosen = rows.select("lang", "h", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    for by in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    chosen = chosen.select("lang", "h").distinct()
    chosen = [(r.lang, r.h) for r in chosen.collect()]  # at most per_language a language
    if not chosen:
        return Model([], [], least)
    ids = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    sample = rows.join(F.broadcast(ids), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    grams = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long")
    counts: dict[str, dict[int, int]] = {lang: {} for lang, _ in chosen}
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r.lang][r.gram] = r.n
    langs = sorted(counts)
    return Model(langs, [counts[x] for x in langs], least)


def _predictor(shared):
    def predict(batches):
        model = object.__new__(Model)
        model.__dict__.update(shared.value)
        uniform = math.log2(model.alphabet)
        for batch in released(batches):
            texts, langs, scores, bits = batch.column("row").field("text"), [], [], []
            for first, data, offsets in chunks(texts, 1 << 18):
                lengths = model.bits(data, offsets) if model.langs else np.zeros((len(offsets) - 1, 0))
                ascii_letter = np.concatenate(([0], np.cumsum((SYMBOLS[data] > 0) & (data < 128))))
                plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for k, row in enumerate(lengths):
                    known = len(row) and (plain[k] or any(map(str.isalpha, texts[first + k].as_py() or "")))
                    if not known:
                        langs.append(UNKNOWN), scores.append(0.0), bits.append(uniform)
                        continue
                    best = int(row.argmin())
                    langs.append(model.langs[best])
                    scores.append(1.0 / float(np.exp2(np.maximum(row[best] - row, -1000)).sum()))
                    bits.append(float(row[best]) / max(1, int(offsets[k + 1] - offsets[k])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(bits, pa.float64()), pa.array([b < uniform for b in bits], pa.bool_())],
                names=["row", "lang_pred", "score", "bits", "accepted"],
            )

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score, bits, accepted) for every row of ``docs`` (text, ...).

    lang_pred has the shortest code for the whole text (ties: the first by name); score is
    its share of the probabilities of all languages, 0 to 1. A text that is null or has no
    letter, and every text if no language was learned, is ``und`` with score 0. accepted
    is false for ``und`` and for texts whose best code is no shorter, per byte, than that
    of random bytes. The input row is in ``row``, so other columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays and lists
    packed = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([
        packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("bits", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
    ])
    return packed.mapInArrow(_predictor(shared), schema)


def held_out(docs: DataFrame):
    """Whether the CRC-32 of doc_id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows not held out; predict every row from its text alone."""
    model = fit(docs.filter(~held_out(docs)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs).alias("held_out"), "text")
    return predict(slim, model).select("row.doc_id", "row.held_out", "lang_pred", "score", F.col("bits").alias("bits_per_byte"))
