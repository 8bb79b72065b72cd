"""Passage dedup: documents are factored against reference blocks of indexed passages."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, chunks, gram_hashes, in_one_text, released, text_megabytes, word_hashes, words

BLOCK_MEGABYTES = 8
_RUN = (1 << 20) - 64  # windows whose anchors are found at a time


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """(valid, hash and anchor position of every window, anchor hashes, first words).

    A window's anchor is its run of ``anchor`` words with the smallest hash, the leftmost
    of equals: it depends on the window's words alone, so equal windows in different
    places have equal anchors, and neighbouring windows mostly share theirs.
    """
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams = gram_hashes(hashes, anchor)
    count = max(0, len(hashes) - window + 1)
    reach = window - anchor + 1
    position = np.empty(count, dtype=np.int64)
    low = np.uint64((1 << 20) - 1)
    for at in range(0, count, _RUN):
        size = min(_RUN, count - at)
        part = grams[at : at + size + reach - 1]
        best, width = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while width < reach:
            step = min(width, reach - width)
            best, width = np.minimum(best[:-step], best[step:]), width + step
        position[at : at + size] = (best & low).astype(np.int64) + at
    return in_one_text(first, window, count), gram_hashes(hashes, window), position, grams, first


def _split(target: np.ndarray, *columns: np.ndarray):
    """(target, columns of its entries) for every target."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    cuts = np.flatnonzero(np.diff(target)) + 1
    parts = [np.split(c[order], cuts) for c in columns]
    for k, at in enumerate(np.concatenate(([0], cuts)) if len(target) else []):
        yield int(target[at]), [p[k] for p in parts]


def _rows(names: list[str], split) -> pa.RecordBatch:
    rows = [(target, *(c.tobytes() for c in columns)) for target, columns in split]
    arrays = [pa.array([r[0] for r in rows], pa.int64())]
    arrays += [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, len(names))]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _joined(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _anchor_rows(window: int, anchor: int, buckets: int, blocks: int):
    """Anchors of every text, dealt by hash, with one of their places in each document:
    the blocks find the others by hash. What a batch already shows to be in two documents
    goes straight to their blocks, with one entry left for the bucket."""

    def rows(batches):
        for batch in released(batches):
            owners = batch.column(0).to_numpy().astype(np.int64)
            keys, docs, places = [], [], []
            for row, data, offsets in chunks(batch.column(1)):
                ok, _, position, grams, first = _windows(data, offsets, window, anchor)
                position = np.unique(position[ok])
                text = np.searchsorted(first, position, side="right") - 1
                keys.append(grams[position])
                docs.append(owners[row + text])
                places.append((position - first[text]).astype(np.uint32))
            if not keys:
                continue
            keys, docs, places = (np.concatenate(x) for x in (keys, docs, places))
            order = np.lexsort((docs, keys))
            keys, docs, places = keys[order], docs[order], places[order]
            one = np.ones(len(keys), dtype=bool)
            one[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs, places = keys[one], docs[one], places[one]
            head = np.ones(len(keys), dtype=bool)
            head[1:] = keys[1:] != keys[:-1]
            group = np.cumsum(head) - 1
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(keys)) - 1
            shared = (docs[at] != docs[last])[group] if len(at) else np.zeros(0, bool)
            yield _rows(
                ["target", "keys", "docs", "places"],
                _split(
                    (keys[head] % np.uint64(buckets)).astype(np.int64),
                    (keys[head] // np.uint64(buckets)).astype(np.uint32), docs[head], places[head],
                ),
            )
            yield _rows(
                ["target", "keys", "docs", "places"],
                _split(-1 - docs[shared] % blocks, np.zeros(int(shared.sum()), np.uint32), docs[shared], places[shared]),
            )

    return rows


def _shared_anchors(blocks: int):
    """A place in each document of anchors that two have, dealt to the documents' blocks."""

    def shared(table: pa.Table) -> pa.Table:
        docs, places = _joined(table["docs"], np.int64), _joined(table["places"], np.uint32)
        if len(table) and table["target"][0].as_py() >= 0:
            keys = _joined(table["keys"], np.uint32)
            order = np.lexsort((docs, keys))
            keys, docs, places = keys[order], docs[order], places[order]
            group = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
            at = np.flatnonzero(np.diff(group, prepend=-1))
            last = np.append(at[1:], len(keys)) - 1
            keep = (docs[at] != docs[last])[group]
            docs, places = docs[keep], places[keep]
        return pa.Table.from_batches([_rows(["block", "docs", "places"], _split(docs % blocks, docs, places))])

    return shared


def _texts_with(table: pa.Table, found: np.ndarray):
    """The rows of ``table`` whose g is in ``found``: (g, d, texts)."""
    g = table["g"].to_numpy().astype(np.int64)
    pick = np.flatnonzero(np.isin(g, found))
    texts = table["text"].combine_chunks().take(pa.array(pick))
    return g[pick], table["d"].to_numpy().astype(np.int64)[pick], texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def _passage_rows(window: int, anchor: int, buckets: int, blocks: int):
    """Windows around shared anchors, wherever in a text these stand. Of equal windows in a
    block those in the smallest document are sent to the reference block of their anchor;
    the others are found here."""

    def rows(table: pa.Table, shared: pa.Table) -> pa.Table:
        docs, places = _joined(shared["docs"], np.int64), _joined(shared["places"], np.uint32)
        names = ["target", "hashes", "docs", "ids", "starts"]
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order].astype(np.int64)
        g, d, texts = _texts_with(table, np.unique(docs))
        parts = []
        for row, data, offsets in chunks(texts) if len(g) else []:
            ok, hashes, position, grams, first = _windows(data, offsets, window, anchor)
            at = np.flatnonzero(ok)
            text = np.searchsorted(first, at, side="right") - 1
            mine = []
            for k in range(len(offsets) - 1):
                lo, hi = np.searchsorted(docs, g[row + k]), np.searchsorted(docs, g[row + k], side="right")
                mine.append(places[lo:hi] + first[k])
            anchors = np.unique(position[at])
            wanted = np.zeros(len(grams) + 1, dtype=bool)
            wanted[anchors[np.isin(grams[anchors], grams[np.concatenate(mine)])]] = True
            near = wanted[position[at]]
            at, text = at[near], text[near]
            bucket = (grams[position[at]] % np.uint64(buckets)).astype(np.int64)
            parts.append((bucket, hashes[at], g[row + text], d[row + text], at - first[text]))
        if not parts:
            return pa.Table.from_batches([_rows(names, [])])
        bucket, h, g, d, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((d, h))
        head = np.ones(len(h), dtype=bool)
        head[1:] = h[order][1:] != h[order][:-1]
        least = d[order][head][np.cumsum(head) - 1]
        seen = np.empty(len(h), dtype=bool)
        seen[order] = d[order] > least
        sent = np.zeros(len(h), dtype=bool)
        sent[order] = d[order] == least
        start = s.astype(np.uint32)
        there = _split(bucket[sent], h[sent], g[sent], d[sent], start[sent])
        here = _split(-1 - g[seen] % blocks, h[seen], g[seen], d[seen], start[seen])
        return pa.Table.from_batches([_rows(names, there), _rows(names, here)])

    return rows


def _factors(window: int, blocks: int):
    """Factor the windows of a reference block against its earliest copies.

    Each window looks up the copy in the smallest document. Windows that follow each other
    in the document and in the same copy form one factor; where the copy changes, the
    window across the boundary has been looked up by itself. Factors are at least
    ``window`` words long and become spans.
    """

    def factors(table: pa.Table) -> pa.Table:
        names = ["block", "docs", "starts", "ends"]
        h, g, d = (_joined(table[c], t) for c, t in (("hashes", np.uint64), ("docs", np.int64), ("ids", np.int64)))
        s = _joined(table["starts"], np.uint32).astype(np.int64)
        if not len(h):
            return pa.Table.from_batches([_rows(names, [])])
        if table["target"][0].as_py() >= 0:
            order = np.lexsort((s, d, h))
            head = np.ones(len(h), dtype=bool)
            head[1:] = h[order][1:] != h[order][:-1]
            source = np.empty(len(h), dtype=np.int64)
            source[order] = order[head][np.cumsum(head) - 1]
            copied = d[source] < d
            g, s, copy, place = g[copied], s[copied], g[source][copied], s[source][copied]
        else:
            copy, place = np.zeros(len(g), np.int64), s
        order = np.lexsort((s, g))
        g, s, copy, place = g[order], s[order], copy[order], place[order]
        goes_on = (g[1:] == g[:-1]) & (copy[1:] == copy[:-1]) & (s[1:] - s[:-1] == place[1:] - place[:-1]) & (s[1:] - s[:-1] <= 1)
        begin = np.concatenate(([True], ~goes_on))[: len(g)]
        end = np.concatenate((~goes_on, [True]))[: len(g)]
        spans = (g[begin], s[begin].astype(np.uint32), (s[end] + window).astype(np.uint32))
        return pa.Table.from_batches([_rows(names, _split(spans[0] % blocks, *spans))])

    return factors


def _without_spans(table: pa.Table, spans: pa.Table) -> pa.Table:
    docs, starts, ends = (_joined(spans[c], t) for c, t in (("docs", np.int64), ("starts", np.uint32), ("ends", np.uint32)))
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    g = table["g"].to_numpy()
    low, high = np.searchsorted(docs, g), np.searchsorted(docs, g, side="right")
    kept, n_words, n_removed, lists = [], [], [], []
    for text, a, b in zip(table["text"], low, high):
        tokens = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        union: list[list[int]] = []
        for start, end in zip(starts[a:b].tolist(), ends[a:b].tolist()):
            if union and start <= union[-1][1]:
                union[-1][1] = max(union[-1][1], end)
            else:
                union.append([start, end])
        n_words.append(len(tokens))
        n_removed.append(sum(end - start for start, end in union))
        for start, end in reversed(union):
            del tokens[start:end]
        kept.append(b" ".join(tokens).decode("utf-8", "surrogatepass"))
        lists.append(union)
    return pa.table({
        "doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "kept_text": pa.array(kept, pa.string()), "spans": pa.array(lists, pa.list_(pa.list_(pa.int64()))),
    })


def dedup_passages(docs: DataFrame, window: int = 13, anchor: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans) for every row of ``docs``.

    A word goes if it is in ``window`` consecutive words that also start in a document
    with a smaller doc_id (null ids count as largest); windows are judged on the input.
    Words are split at ASCII white space; kept words are joined by one space; a null text
    has none. Rows with equal doc_id do not take words from each other; other columns are
    ignored. Windows are equal if 64-bit hashes of them and of their anchors are.

    1. Anchors: every window holds one, and only their hashes are dealt out, to find those
       that two documents have. 2. Windows with a shared anchor go to the reference block
       of that anchor, after the copies within a block of documents have been settled
       there. 3. Each reference block is indexed and the windows are factored against it.
       4. Factors return to their documents. Texts are shuffled once, into blocks of about
       8 MB; a passage in many documents reaches its block once per block of documents.
    """
    size = text_megabytes(docs)
    blocks = buckets = max(4, ceil(size / BLOCK_MEGABYTES))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"),
        F.shiftrightunsigned(F.xxhash64(d, F.col("text")), 1).alias("g"), F.col("text").cast("string").alias("text"),
    ).withColumn("block", F.col("g") % blocks)
    anchors = base.select("g", "text").mapInArrow(
        _anchor_rows(window, anchor, buckets, blocks), "target long, keys binary, docs binary, places binary"
    )
    shared = anchors.groupBy("target").applyInArrow(_shared_anchors(blocks), "block long, docs binary, places binary")
    by_block = base.groupBy("block")
    passages = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        _passage_rows(window, anchor, buckets, blocks),
        "target long, hashes binary, docs binary, ids binary, starts binary",
    )
    spans = passages.groupBy("target").applyInArrow(
        _factors(window, blocks), "block long, docs binary, starts binary, ends binary"
    )
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(
        _without_spans, "doc_id long, n_words long, n_removed long, kept_text string, spans array<array<long>>"
    )
