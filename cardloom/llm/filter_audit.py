"""Filter interaction audit: what every order of five text filters removes, and where.

Each text is measured once. What is left is a count per part and set of failed filters: 32
cells a part, which answer every order of the filters.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, released, written

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SLICE = 1 << 20
_REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def word_counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words, split at ASCII white space, in slices of the text."""
    if len(raw) <= _SLICE:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + _SLICE)
        end = gap.start() if gap else len(raw)
        words = raw[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failures(raw: bytes) -> int:
    """Bits of the filters that a text fails on its own: A, B, C, D from the lowest."""
    n, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    chars = len(raw.decode("utf-8", "replace"))
    return (
        (n < LEAST_WORDS)
        | (100 * distinct < DISTINCT_PERCENT * n) << 1
        | (100 * capitals > CAPITALS_PERCENT * chars) << 2
        | bool(_MARKS.search(raw)) << 3
    )


def _measure(batches):
    for batch in released(batches):
        masks, digests = [], []
        for value in batch.column(2):
            raw = value.as_py() or b""
            masks.append(failures(raw))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["id", "part", "mask", "digest"],
        )


def failed_filters(docs: DataFrame) -> DataFrame:
    """(id, part, mask) per row of ``docs``: the bits of the filters A to E that it fails.

    E asks for the smallest doc_id of an equal text in the whole table. Texts are compared
    by their SHA-256. Texts with very many copies meet their smallest doc_id by broadcast.
    """
    packed = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    rows = written(packed.mapInArrow(_measure, "id long, part string, mask int, digest binary"), "filters")
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1")
    found = by_key(rows, written(copies, "filter-copies"), ["digest"], "n", rows.count(), "left")
    copied = F.expr("coalesce(first is not null and (id is null or id > first), false)")
    return found.select("id", "part", F.when(copied, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows, and those whose doc_id is labelled good or toxic.

    Rows are counted by doc_id first, so that a doc_id that very many rows share, or that
    is null, is one row per part and mask before the labels are joined.
    """
    counted = masks.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    mine = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("n")).otherwise(0)).cast("long").alias(flag)
    return counted.join(known, "id", "left").groupBy("part", "mask").agg(
        F.sum("n").cast("long").alias("n"), mine("good"), mine("toxic")
    )


def survivors(counts: dict[int, tuple[int, ...]], filters: int) -> list[tuple[int, ...]]:
    """What is left under every set of active filters, indexed by the set's bits.

    The sets are walked in Gray-code order, so that a step switches one filter. Each cell
    knows how many active filters it fails; only cells whose number leaves or reaches zero
    change what is left.
    """
    left = tuple(map(sum, zip(*counts.values())))
    failing = dict.fromkeys(counts, 0)
    states = [left] * (1 << filters)
    active = 0
    for step in range(1, 1 << filters):
        bit = step & -step
        active ^= bit
        change = 1 if active & bit else -1
        for mask, held in counts.items():
            if mask & bit:
                before, failing[mask] = failing[mask], failing[mask] + change
                if min(before, failing[mask]) == 0:
                    left = tuple(x - change * y for x, y in zip(left, held))
        states[active] = left
    return states


def order_rows(part: str, counts: dict[int, tuple[int, int, int]], letters: str = FILTERS) -> list[tuple]:
    """A row per order of the filters and step, from differences of stored states."""
    states = survivors(counts, len(letters))
    bits = {letter: 1 << k for k, letter in enumerate(letters)}
    fails = {x: sum(c[0] for mask, c in counts.items() if mask & bit) for x, bit in bits.items()}
    alone = {x: counts.get(bit, (0, 0, 0))[0] for x, bit in bits.items()}
    rows, shares = [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        active = 0
        for step, letter in enumerate(order, 1):
            before, active = states[active], active | bits[letter]
            now = states[active]
            removed, good, toxic = (x - y for x, y in zip(before, now))
            shares[letter] += removed
            rows.append((part, "".join(order), step, now[0], removed, fails[letter] - removed, alone[letter], good, toxic))
    return [(*row, shares[row[1][row[2] - 1]]) for row in rows]


def _report(frames):
    names = [x.split()[0] for x in _REPORT.split(", ")]
    for frame in frames:
        for part, held in zip(frame["part"], frame["held"]):
            counts = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in held}
            yield pd.DataFrame(order_rows(part, counts), columns=names)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``lang``, null as empty), order of the five filters and step.

    Counts are of rows within the part: kept after the step, removed by it, redundant (fail
    its filter, removed earlier), unique_fails (fail its filter only), good_lost and
    toxic_lost (removed here, labelled quality 1 or toxic 1), and shapley: what its filter
    removes, summed over all orders. A doc_id with several labels has each that any of them
    gives. Null texts are empty, null doc_ids come last and have no label, repeated rows
    count each and are no copies of each other, an empty table gives no rows, very long
    texts are measured whole, other columns are ignored.

    Only measures of texts are shuffled; at most 32 cells of a part meet in one row.
    """
    counted = cells(failed_filters(docs.select("doc_id", "text", "lang")), labels.select("doc_id", "quality", "toxic"))
    packed = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    return packed.mapInPandas(_report, _REPORT)
