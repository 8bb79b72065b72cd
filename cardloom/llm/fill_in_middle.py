"""Fill-in-middle transformation: code points are found in 64-bit words of UTF-8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, released

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ONES = np.uint64(0x0101010101010101)


class Units:
    """Code points of a UTF-8 buffer, which holds whole texts one after the other.

    The buffer is read as little-endian 64-bit words. A byte ends a code point if the byte
    after it is no continuation byte (10xxxxxx); such bytes get a one in their lowest bit,
    for eight bytes at a time. Counts per word and their running sum answer ``rank`` and
    ``select`` without a table of code points.
    """

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 1) * 8, dtype=np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        starts = ((words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _ONES) ^ _ONES
        after = np.append(starts[1:], _ONES)
        self.ends = (starts >> np.uint64(8)) | (after << np.uint64(56))
        self.upto = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.upto[1:])

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """Code points that end before each byte offset."""
        word, byte = offsets >> 3, (offsets & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, count: np.ndarray) -> np.ndarray:
        """The byte offset after each ``count``-th code point, counted from one; 0 is 0."""
        word = np.maximum(np.searchsorted(self.upto, count, side="left") - 1, 0)
        missing = (count - self.upto[word])[:, None]
        # Byte j of the product counts the ends in bytes 0 to j.
        running = (self.ends[word] * _ONES).astype("<u8").view(np.uint8).reshape(-1, 8)
        inside = (running < missing).sum(axis=1) + 1
        return np.where(count > 0, word * 8 + inside, 0)


def _assembled(text: bytes, form: str, a: int, b: int) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def _transform(batches):
    """(doc_id, n, form, prefix_chars, middle_chars, output) of doc_id, text, form, h1, h2."""
    for batch in released(batches):
        draws = np.sort(np.stack([batch.column(k).to_numpy() for k in (3, 4)]), axis=0)
        for row, data, offsets in chunks(batch.column(1)):
            rows = len(offsets) - 1
            units = Units(data)
            at = units.rank(offsets)
            n = np.diff(at)
            # n+1 is the same for both draws, but remainders need not keep their order.
            low, high = np.sort(draws[:, row : row + rows] % (n + 1), axis=0)
            cuts = [units.select(at[:-1] + cut) for cut in (low, high)]
            # A cut before the first code point is where the text begins.
            a, b = (np.where(cut > 0, end, offsets[:-1]) - offsets[:-1] for cut, end in zip((low, high), cuts))
            forms = batch.column(2).slice(row, rows).to_pylist()
            raw = data.tobytes()
            output = [
                _assembled(raw[offsets[i] : offsets[i + 1]], forms[i], int(a[i]), int(b[i])) for i in range(rows)
            ]
            plain = np.array([form == "plain" for form in forms], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, rows), pa.array(n, pa.int64()), batch.column(2).slice(row, rows),
                    pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    A text of ``n`` code points is cut at two of its n + 1 borders, drawn from the first
    two of four 32-bit numbers that the SHA-256 of ``seed``:doc_id gives; the third and
    fourth choose the form. ``psm`` is prefix, suffix, middle, each behind its sentinel,
    ``spm`` is suffix, prefix, middle, ``plain`` is the text itself, with null lengths.
    Texts that are empty or hold a sentinel are always plain, so that ``restored`` is exact.

    A null text is empty, a null doc_id is drawn as an empty one, repeated rows give the
    same output each, an empty table gives none, very long texts are cut like others, other
    columns are ignored. One pass over each text, nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(sentinel))
    form = (
        F.when((F.col("text") == "") | marked | (h[2] % 100 >= 100 - plain_percent), "plain")
        .when(h[3] % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    return rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2")).mapInArrow(
        _transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Only whole sentinels stand in an output, as
    a text with one is plain and no sentinel can begin inside another."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )
