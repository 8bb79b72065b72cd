"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Bytes of item text per automaton: bounds what is broadcast and held by a task.
BLOCK_BYTES = 2 << 20


def _words(text: str | None) -> list[bytes]:
    """Lower-cased words; everything in ASCII but letters and digits separates."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """All runs of words of a block of items, with the items that own each window."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        texts = [(item, ws) for item, text in items if (ws := _words(text))]
        for _, ws in texts:
            last = 0
            for word in ws:
                last = self._extend(last, word)
        for item, ws in texts:
            state = 0
            for k, word in enumerate(ws):
                state = self.next[state][word]
                if k + 1 >= window:
                    self.owners.setdefault(self._suffix(state, window), set()).add(item)
            if len(ws) < window:
                self.short.setdefault(self._suffix(state, len(ws)), {}).setdefault(len(ws), set()).add(item)
        self.least = min([window, *(n for found in self.short.values() for n in found)])

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` for the runs that end here and are shorter."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            whole = self.length[target] == self.length[state] + 1
            self.link[new] = target if whole else self._split(state, word, target)
        return new

    def _suffix(self, state: int, n: int) -> int:
        """The state that stands for the last ``n`` words of ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Word spans [start, end) covered by windows of items, and the items."""
        moves, link, lengths = self.next, self.link, self.length
        spans: list[list[int]] = []
        items: set = set()
        state = length = 0
        root, least = moves[0], self.least
        for k, word in enumerate(words):
            following = moves[state].get(word)
            if following is None:
                if not state:
                    continue
                while following is None and state:
                    state = link[state]
                    following = moves[state].get(word) if state else root.get(word)
                if following is None:
                    state = length = 0
                    continue
                length = lengths[state]
            state = following
            length += 1
            if length >= least:
                self._record(state, length, k + 1, spans, items)
        return spans, items

    def _record(self, state: int, length: int, end: int, spans: list, items: set) -> None:
        reach = 0
        if length >= self.window:
            reach = self.window
            items |= self.owners[self._suffix(state, self.window)]
        if self.short:
            at = state
            while at > 0:
                for n, found in self.short.get(at, {}).items():
                    if n <= length:
                        reach = max(reach, n)
                        items |= found
                at = self.link[at]
        if reach:
            start = end - reach
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])


def cut(text: str, spans: list) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _scanner(items, window: int, cutting: bool):
    def scan(batches):
        automaton = Automaton(items.value, window)
        for batch in released(batches):
            counts, spans, found, clean = [], [], [], []
            for text, had, owned in zip(batch.column("row").field("text"), batch.column("spans"), batch.column("items")):
                words = _words(text.as_py())
                more, ids = automaton.scan(words)
                counts.append(len(words))
                spans.append(_union([*had.as_py(), *more]))
                found.append(sorted({*owned.as_py(), *(x for x in ids if x is not None)}))
                clean.append(cut(text.as_py(), spans[-1]) if cutting and spans[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array(found, pa.list_(pa.int64())), pa.array(clean, pa.string())],
                names=["row", "n_words", "spans", "items", "clean"],
            )

    return scan


def _union(spans: list) -> list:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, cutting: bool = False) -> DataFrame:
    """(row, n_words, spans, items, clean) for every row of ``docs`` (text, ...).

    Words are runs of letters and digits (and everything beyond ASCII), A-Z lower-cased.
    A window is ``window`` consecutive words of an item, or all of a shorter item. Spans
    are the word ranges covered by windows; items are the ids with a window there (null
    ids cover words but are not listed). ``clean`` is the text without the spans, if there
    are any and ``cutting`` asks for it, else null. ``row`` holds the input row, so extra columns may
    have any names. Items are split by hash into blocks of at most about 2 MB of text, one
    automaton each; with several, the texts are written once and pass through one block
    after another, so that a task holds one automaton. Null texts and items have no words.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, ceil(2 * size / BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    if blocks == 1:
        state = docs.select(F.struct("*").alias("row"), *_nothing_found())
        last = items
    else:
        state, last = _hits_of_blocks(docs, items, blocks, window), items.limit(0)
    schema = T.StructType([
        state.schema["row"], T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("clean", T.StringType()),
    ])
    return state.mapInArrow(_scanner(_shared(last), window, cutting), schema)


def _nothing_found() -> list:
    return [F.expr("cast(array() as array<array<bigint>>)").alias("spans"), F.expr("cast(array() as array<bigint>)").alias("items")]


def _shared(items: DataFrame):
    """The items of one block (its size is bounded) for all tasks."""
    return items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])


def _finder(items, window: int):
    """(number, spans, items) of the rows (number, text) in which a block's windows occur."""

    def find(batches):
        automaton = Automaton(items.value, window)
        for batch in released(batches):
            numbers, spans, found = [], [], []
            for number, text in zip(batch.column(0), batch.column(1)):
                covered, ids = automaton.scan(_words(text.as_py()))
                if covered:
                    numbers.append(number.as_py())
                    spans.append(covered)
                    found.append(sorted(x for x in ids if x is not None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array(found, pa.list_(pa.int64()))],
                names=["number", "spans", "items"],
            )

    return find


def _hits_of_blocks(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """(row, spans, items) of all blocks: one pass and one automaton at a time."""
    numbered = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")), "numbered")
    texts = numbered.select("number", F.col("row.text").cast("string").alias("text"))
    hits = None
    for k in range(blocks):
        shared = _shared(items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k))
        found = texts.mapInArrow(_finder(shared, window), "number long, spans array<array<long>>, items array<long>")
        part = written(found, "block-hits")
        shared.unpersist()
        hits = part if hits is None else hits.union(part)
    per_row = hits.groupBy("number").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    spans, found = _nothing_found()
    return numbered.join(per_row, "number", "left").select(
        "row", F.coalesce("spans", spans).alias("spans"), F.coalesce("items", found).alias("items")
    )


def judged(hits: DataFrame, share: int = 20) -> DataFrame:
    """``hits`` with n_hit and contaminated: hit words are at least 1 in ``share``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judged(benchmark_hits(docs, benchmark, window)).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without contaminated rows (coverage limit) and, in the others, without the
    word spans that reach the length limit. Same columns; texts without a hit unchanged."""
    kept = judged(benchmark_hits(docs, benchmark, window, cutting=True)).filter("not contaminated")
    changed = F.col("clean").isNotNull()
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.coalesce("clean", "row.text")
    if "n_chars" in columns:
        length = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(changed, length).otherwise(F.col("row.n_chars"))
    return kept.select(*[value.alias(name) for name, value in columns.items()])
