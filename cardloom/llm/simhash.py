"""Near-duplicate documents by SimHash, linked by generalised pigeonhole search."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .components import components

BITS = 64


def _fingerprint(text: str | None, words_per_shingle: int = 3, block: int = 1 << 16) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
        return _majority([np.array(hashes, dtype=np.uint64)])
    joined = b" ".join(words)
    starts = [0]
    for word in words:
        starts.append(starts[-1] + len(word) + 1)
    digest, ends = xxhash.xxh64_intdigest, starts[words_per_shingle:]
    parts = (
        np.array(
            [digest(joined[a : b - 1], 42) for a, b in zip(starts[k : k + block], ends[k : k + block])],
            dtype=np.uint64,
        )
        for k in range(0, len(ends), block)
    )
    return _majority(parts)


def _majority(parts) -> int:
    """The bits set in over half of the hashes, counted a block at a time."""
    total, ones = 0, np.zeros(BITS, dtype=np.int64)
    for part in parts:
        total += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches):
    for batch in released(batches):
        prints = np.fromiter((_fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text as a signed long.

    Null texts, empty texts and texts without words get zero.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


# ---- bit groups and thresholds ----


def _bit_counts(batches):
    """How often each pair of bits is set together, in this partition."""
    counts = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        counts += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()])], names=["counts"])


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"counts": [total.tobytes()]})


def bit_statistics(prints: DataFrame, fan_in: int = 16) -> np.ndarray:
    """64 x 64 counts over all fingerprints; at most ``fan_in`` tables reach the driver."""
    partial = prints.select("fp").mapInArrow(_bit_counts, "counts binary")
    rows = (
        partial.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
        .groupBy("slot")
        .applyInArrow(_sum_counts, "counts binary")
        .collect()
    )
    total = sum((np.frombuffer(r.counts, np.int64) for r in rows), np.zeros(BITS * BITS, np.int64))
    return total.reshape(BITS, BITS)


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the bits into equal groups, each grown around its most correlated bits."""
    share = counts / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (related[b, rest].sum(), -b))]
        while len(group) < size:
            left = sorted(free - set(group))
            group.append(max(left, key=lambda b: (related[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def allocate_thresholds(p: np.ndarray, n: int, groups: list[list[int]], limit: int) -> list[int]:
    """Thresholds t with sum(t + 1) = limit + 1 and the least expected work.

    A part with threshold t costs its probes and the candidates expected from the
    distribution of the distance of two fingerprints within the part. -1 leaves a part
    out. Any two fingerprints within ``limit`` bits are within t in some part.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        differ = np.array([1.0])
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            differ = np.convolve(differ, [1 - q, q])
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, limit - used + 1):
                probes = n * sum(comb(len(group), d) for d in range(t + 1)) / 2
                candidates = n * n / 2 * differ[: t + 1].sum()
                total = cost + probes + candidates
                key = used + t + 1
                if key <= limit + 1 and (key not in following or total < following[key][0]):
                    following[key] = (total, [*chosen, t])
        best = following
    return best[limit + 1][1]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(group: list[int], t: int) -> list[tuple[int, int]]:
    """(mask, highest bit) of every set of 1 to t bits of the group."""
    return [
        (_signed(sum(1 << b for b in bits)), max(bits))
        for d in range(1, t + 1)
        for bits in combinations(group, d)
    ]


def links(prints: DataFrame, limit: int = 3, parts: int = 2) -> DataFrame:
    """(u, v): every two distinct fingerprints that differ in ``limit`` bits or fewer.

    ``prints`` has distinct fingerprints. Bits are grouped by correlation, thresholds are
    allocated per group, and in each group one side probes the other's index with every
    value in reach. Of two values that differ in a group only the one with the higher
    differing bit set probes, so half of the probes are enough. Two halves of 32 bits make
    the number of probes grow with the number of fingerprints, not with its square.
    """
    n = prints.count()
    counts = bit_statistics(prints)
    groups = group_bits(counts, n, parts)
    thresholds = allocate_thresholds(np.diag(counts) / max(n, 1), n, groups, limit)
    index, probes = [], []
    for k, (group, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))
        index.append(f"struct({k} as part, fp & {_signed(sum(1 << b for b in group))}L as key)")
        reach = [F.when(F.lit(True), key)]
        reach += [
            F.when(F.getbit("fp", F.lit(high)) == 1, key.bitwiseXOR(F.lit(mask))) for mask, high in _flips(group, t)
        ]
        probes.append(
            prints.select(F.lit(k).alias("part"), "fp", F.explode(F.array_compact(F.array(*reach))).alias("key"))
        )
    right = prints.select("fp", F.inline(F.expr(f"array({', '.join(index)})"))).select(
        "part", "key", F.col("fp").alias("other")
    )
    left = probes[0]
    for more in probes[1:]:
        left = left.union(more)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= limit
    return (
        left.join(right, (left.part == right.part) & (left.key == right.key) & near & (left.fp != right.other))
        .select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))
        .distinct()
    )


def component_table(prints: DataFrame, limit: int = 3, parts: int = 2) -> DataFrame:
    """(fp, root): the group of every distinct fingerprint in ``prints`` (fp, ...)."""
    distinct = written(prints.select("fp").distinct(), "fingerprints")
    groups = components(links(distinct, limit, parts))
    return distinct.join(groups, distinct.fp == groups.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, limit: int = 3, parts: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    Fingerprints link at ``limit`` or fewer differing bits; component_id is the smallest
    doc_id reachable. Copies share a fingerprint and are linked once for all. Rows without
    words have fingerprint zero and are linked like any other. Repeated rows are returned
    each; a null doc_id is returned with its component and never is a component's id
    unless all ids are null. Other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs), "prints")
    groups = component_table(prints, limit, parts)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = groups.join(least, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return (
        prints.join(named.join(ids, "root").select("fp", "component_id"), "fp")
        .select(
            "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
        )
    )


def _numbered_batches(batches):
    from pyspark import TaskContext

    base, count = TaskContext.get().partitionId() << 40, 0
    for batch in released(batches):
        texts = batch.column(0).field("text")
        prints = np.fromiter((_fingerprint(x.as_py()) for x in texts), np.uint64, batch.num_rows)
        rows = np.arange(count, count + batch.num_rows, dtype=np.int64) + base
        count += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows), pa.array(prints.view(np.int64))], names=["row", "number", "fp"]
        )


def keep_one(docs: DataFrame, limit: int = 3, parts: int = 2) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near-duplicates, all columns.

    Of each component the row with the smallest doc_id stays (null ids last, then the
    first written); of repeated rows one stays. Columns may have any names. Texts are
    written once with fingerprint and row number; everything else works on numbers.
    """
    from pyspark.sql import types as T

    packed = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("number", T.LongType()), T.StructField("fp", T.LongType())])
    table = written(packed.mapInArrow(_numbered_batches, schema), "numbered")
    slim = table.select(
        "number", "fp", F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")
    )
    groups = component_table(slim, limit, parts)
    first = slim.groupBy("fp").agg(F.min(F.struct("id", "number")).alias("first"))
    kept = first.join(groups, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.number")
    return table.join(kept, "number", "left_semi").select("row.*")
