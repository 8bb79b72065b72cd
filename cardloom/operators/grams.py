"""Counts of n-grams over blocks of documents, in numpy inside Arrow tasks.

Words and grams are numbered within a block and counted as numbers; a gram's text is made
once per block. Where words have numbers of the whole corpus, so have grams (``Coding``), and
no text of a gram is made at all. Blocks are bounded here or by the callers; what Arrow holds
of a block goes back to the system, as Python workers are kept and share an executor's memory.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get this module's code with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words, or bytes of text, of a block that is counted at once, and rows of a batch that leaves a task.
BLOCK_WORDS, BLOCK_BYTES = 500_000, 3 << 20
BATCH_ROWS = 65_536
# Documents of a batch of packed rows.
PACKED_ROWS = 512


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Every value's number, by first appearance, and the distinct values."""
    encoded = values.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def _column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _release() -> None:
    pa.default_memory_pool().release_unused()


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(column: pa.Array, sizes: np.ndarray, most: int) -> Iterator[pa.Array]:
    """Slices of a column whose sizes sum up to ``most`` at most, or of one row."""
    upto, at = np.cumsum(sizes), 0
    while at < len(upto):
        done = upto[at - 1] if at else 0
        end = max(int(np.searchsorted(upto, done + most, side="right")), at + 1)
        yield column.slice(at, end - at)
        at = end


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _in_batches(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(table.combine_chunks().to_batches(max_chunksize=BATCH_ROWS), table.schema)


_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut(texts: pa.Array, lowercase: bool) -> pa.Array:
    """The words of every text (see ``spaced_words``), a list per text. Other letters than those
    of ASCII are in lower case already, if they are to be."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    # A place more, which is in no word, so that each change is the start or the end of one.
    inside = np.append(_WORD[data], False)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[at[:-1]] = inside[at[:-1]]
    starts = np.flatnonzero(start)
    inside = inside[:-1]
    # Bytes in words before each word, as words are laid next to each other.
    first = np.append((np.cumsum(inside) - inside)[starts], np.count_nonzero(inside)).astype(np.int32)
    letters = data[inside]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(first), pa.py_buffer(_LOWER[letters] if lowercase else letters))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), words)


def counted(words: pa.Array, docs: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``(doc, gram, count)`` of every pair that occurs, by doc and gram, and the grams' texts.

    ``words`` has a list per text, ``docs`` the number of the document that the text is of.
    """
    lengths = _lengths(words)
    word, texts = _numbered(words.flatten())
    text_no = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    doc = docs.astype(np.int32)[text_no]
    gram, gram_texts, places, found, found_texts, n_grams = word, texts, np.arange(len(word), dtype=np.int32), [], [], 0
    width = max(len(texts), 1)
    for n in range(1, high + 1):
        if n > 1:
            # A gram goes on with the next word, if that is of the same text.
            inside = places + (n - 1) < len(word)
            inside[inside] = text_no[places[inside] + (n - 1)] == text_no[places[inside]]
            places, gram = places[inside], gram[inside].astype(np.int64)
            gram, pairs = _numbered(pa.array(gram * width + word[places + (n - 1)]))
            pairs = pairs.to_numpy(zero_copy_only=False)
            left, right = pairs // width, pairs % width
            gram_texts = pc.binary_join_element_wise(gram_texts.take(pa.array(left)), texts.take(pa.array(right)), " ")
        if n >= low:
            found.append((doc[places], gram.astype(np.int64) + n_grams))
            found_texts.append(gram_texts)
            n_grams += len(gram_texts)
    keys = np.concatenate([d * np.int64(n_grams) + g for d, g in found])
    keys, counts = np.unique(keys, return_counts=True)
    return keys // max(n_grams, 1), keys % max(n_grams, 1), counts, pa.concat_arrays(found_texts)


def frequencies(low: int, high: int, lowercase: bool, block_bytes: int = BLOCK_BYTES) -> Callable:
    """For ``mapInArrow`` over texts: ``(term, df, corpus_tf)`` of every block of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for part in _slices(texts, pc.binary_length(texts).to_numpy(zero_copy_only=False), block_bytes):
                _, gram, counts, terms = counted(cut(part, lowercase), np.arange(len(part)), low, high)
                table = pa.table({
                    "term": terms,
                    "df": np.bincount(gram, minlength=len(terms)).astype(np.int64),
                    "corpus_tf": np.bincount(gram, counts, minlength=len(terms)).astype(np.int64),
                })
                yield from table.to_batches(max_chunksize=BATCH_ROWS)
                _release()

    return run


def chunk_terms(low: int, high: int, lowercase: bool) -> Callable:
    """For one chunk of ``(chunk, id, text)``: its distinct grams, ``(chunk, term)``."""

    def run(table: pa.Table) -> pa.Table:
        words = cut(_column(table["text"]), lowercase)
        *_, texts = counted(words, np.zeros(len(words), np.int64), low, high)
        chunk = table["chunk"][0].as_py()
        return _in_batches(pa.table({"chunk": np.full(len(texts), chunk, np.int32), "term": texts}))

    return run


def _weighed(
    doc: np.ndarray, place: np.ndarray, counts: np.ndarray, n: int, known: pa.Table, sublinear: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, place, index, weight)`` by doc and term index: unit-length rows of the counted pairs
    whose place in ``known`` is not -1."""
    kept = place >= 0
    doc, counts, place = doc[kept], counts[kept], place[kept]
    index = _column(known["term_idx"]).to_numpy(zero_copy_only=False)[place]
    order = np.lexsort((index, doc))
    doc, counts, place, index = doc[order], counts[order], place[order], index[order]
    tf = 1.0 + np.log(counts) if sublinear else counts.astype(float)
    score = tf * _column(known["idf"]).to_numpy(zero_copy_only=False)[place]
    norm = np.sqrt(np.bincount(doc, score * score, minlength=n))
    return doc, place, index, score / norm[doc]


def _long_rows(ids: pa.Array, terms: pa.Array, doc: np.ndarray, place: np.ndarray, index: np.ndarray, weight: np.ndarray) -> pa.Table:
    """``(id, term, term_idx, weight)`` in batches."""
    batches = []
    for at in range(0, len(doc), BATCH_ROWS):
        part = slice(at, at + BATCH_ROWS)
        batches.append(pa.RecordBatch.from_arrays(
            [ids.take(pa.array(doc[part])), terms.take(pa.array(place[part])),
             pa.array(index[part].astype(np.int32)), pa.array(weight[part])],
            names=["id", "term", "term_idx", "weight"],
        ))
    schema = pa.schema([("id", ids.type), ("term", terms.type), ("term_idx", pa.int32()), ("weight", pa.float64())])
    return pa.Table.from_batches(batches, schema)


def chunk_weights(low: int, high: int, lowercase: bool, sublinear: bool) -> Callable:
    """For one chunk of ``(chunk, id, text)`` and the terms of the vocabulary that it has,
    ``(chunk, term, term_idx, idf)``: unit-length rows by document and term index."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        docs, ids = _numbered(_column(table["id"]))
        doc, gram, counts, texts = counted(cut(_column(table["text"]), lowercase), docs, low, high)
        terms = _column(known["term"])
        place = pc.index_in(texts, value_set=terms)
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)[gram]
        return _long_rows(ids, terms, *_weighed(doc, place, counts, len(ids), known, sublinear))

    return run


def packed_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, indices, weights)`` of rows ``(id, term_idx, weight)``: one row for each id of a
    batch, by term index."""
    for batch in batches:
        docs, ids = _numbered(batch.column(0))
        index = batch.column(1).to_numpy(zero_copy_only=False)
        weight = batch.column(2).to_numpy(zero_copy_only=False)
        order = np.lexsort((weight, index, docs))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(ids)))]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.ListArray.from_arrays(offsets, pa.array(index[order].astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(weight[order]))],
            names=["id", "indices", "weights"],
        )


# Words with numbers of the whole corpus


@dataclass(frozen=True)
class Coding:
    """Numbers of grams of ``low`` to ``high`` words that have the numbers 0 to ``words`` - 1:
    a gram's words are the digits, and shorter grams come first."""

    words: int
    low: int
    high: int

    def first(self, n: int) -> int:
        """The number of the first gram of ``n`` words."""
        return sum(self.words**m for m in range(1, n))

    def fits(self) -> bool:
        """Whether words are ints and grams longs."""
        return self.words < 1 << 31 and self.first(self.high + 1) < 1 << 62

    def digit(self, place: int, gram: str = "gram") -> str:
        """SQL for the number of a gram's word at a place, null behind its last word."""
        cases = " ".join(
            f"when {gram} < {self.first(n + 1)}L then pmod(({gram} - {self.first(n)}L) div {self.words ** (n - place)}L, {self.words}L)"
            if n >= place else f"when {gram} < {self.first(n + 1)}L then null"
            for n in range(self.low, self.high + 1)
        )
        return f"case {cases} end"

    def grams(self, codes: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(doc, gram)`` of every place where one begins; a word numbered -1 is in none.

        ``codes`` has a list per text, ``docs`` the number of the document that the text is of.
        """
        text = np.repeat(np.arange(len(codes), dtype=np.int32), _lengths(codes))
        word = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        gram, inside, found = word, word >= 0, []
        for n in range(1, self.high + 1):
            if n > 1:
                gram = gram[:-1] * self.words + word[n - 1 :]
                inside = inside[:-1] & (word[n - 1 :] >= 0) & (text[: len(gram)] == text[n - 1 :])
            if n >= self.low:
                found.append((docs[text[: len(gram)][inside]], gram[inside] + self.first(n)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def counted(self, codes: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, place, count)`` of every pair that occurs, by doc, and the grams at the places."""
        doc, gram = self.grams(codes, docs)
        place, grams = _numbered(pa.array(gram))
        width = np.int64(max(len(grams), 1))
        pairs, counts = np.unique(doc * width + place, return_counts=True)
        return pairs // width, pairs % width, counts, grams.to_numpy(zero_copy_only=False)


def numbered_words(lowercase: bool) -> Callable:
    """For one chunk of ``(chunk, id, text)``: each text with its words as numbers, and one row
    more, which lists the words by number with their document frequencies."""

    def run(table: pa.Table) -> pa.Table:
        lists = cut(_column(table["text"]), lowercase)
        lengths = _lengths(lists)
        word, texts = _numbered(lists.flatten())
        n = max(len(texts), 1)
        pairs = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n + word)
        codes = pa.table({"chunk": table["chunk"], "id": table["id"], "codes": _lists(lengths, pa.array(word.astype(np.int32)))})
        one = np.array([len(texts)])
        df = pa.array(np.bincount(pairs % n, minlength=len(texts)))
        listed = pa.table({"chunk": table["chunk"].slice(0, 1), "words": _lists(one, texts), "df": _lists(one, df)})
        out = pa.concat_tables([codes, listed], promote_options="default")
        _release()
        return out.select(["chunk", "id", "codes", "words", "df"])

    return run


def renumbered(table: pa.Table, known: pa.Table) -> pa.Table:
    """For one chunk of ``(chunk, id, codes)`` and the ``(chunk, place, code)`` of its words that
    the corpus numbers: the texts in these numbers, -1 for other words."""
    lists = _column(table["codes"])
    word = lists.flatten().to_numpy(zero_copy_only=False)
    code = np.full(word.max(initial=-1) + 1, -1, np.int32)
    code[_column(known["place"]).to_numpy(zero_copy_only=False)] = _column(known["code"]).to_numpy(zero_copy_only=False)
    return pa.table({"chunk": table["chunk"], "id": table["id"], "codes": _lists(_lengths(lists), pa.array(code[word]))})


def coded_frequencies(coding: Coding, block_words: int = BLOCK_WORDS) -> Callable:
    """For ``mapInArrow`` over lists of words' numbers: ``(gram, df, corpus_tf)`` of every block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in _slices(batch.column(0), _lengths(batch.column(0)), block_words):
                _, place, counts, grams = coding.counted(codes, np.arange(len(codes)))
                table = pa.table({
                    "gram": grams,
                    "df": np.bincount(place, minlength=len(grams)).astype(np.int64),
                    "corpus_tf": np.bincount(place, counts, minlength=len(grams)).astype(np.int64),
                })
                yield from table.to_batches(max_chunksize=BATCH_ROWS)
            _release()

    return run


def chunk_grams(coding: Coding) -> Callable:
    """For one chunk of ``(chunk, id, codes)``: its distinct grams, ``(chunk, gram)``."""

    def run(table: pa.Table) -> pa.Table:
        codes = _column(table["codes"])
        _, gram = coding.grams(codes, np.zeros(len(codes), np.int64))
        gram = np.unique(gram)
        return _in_batches(pa.table({"chunk": np.full(len(gram), table["chunk"][0].as_py(), np.int32), "gram": gram}))

    return run


def coded_weights(coding: Coding, sublinear: bool, packed: bool) -> Callable:
    """For one chunk of ``(chunk, id, codes)`` and the grams of the vocabulary that it has,
    ``(chunk, gram, term_idx, idf)``, and with them ``term`` unless rows are to be packed: unit-length
    rows by document and term index, ``packed`` into one row a document that has terms."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        docs, ids = _numbered(_column(table["id"]))
        doc, place, counts, grams = coding.counted(_column(table["codes"]), docs.astype(np.int64))
        found = pc.index_in(pa.array(grams), value_set=_column(known["gram"]))
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)[place]
        weighed = _weighed(doc, place, counts, len(ids), known, sublinear)
        if packed:
            doc, _, index, weight = weighed
            size = np.bincount(doc, minlength=len(ids))
            row = np.flatnonzero(size)
            out = pa.table({
                "id": ids.take(pa.array(row)), "indices": _lists(size[row], pa.array(index.astype(np.int32))),
                "weights": _lists(size[row], pa.array(weight)),
            })
            out = pa.Table.from_batches(out.combine_chunks().to_batches(max_chunksize=PACKED_ROWS), out.schema)
        else:
            out = _long_rows(ids, _column(known["term"]), *weighed)
        _release()
        return out

    return run
