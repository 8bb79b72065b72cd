"""SHA-256 of long files, each by a chain of tasks that read one split of the file.

A SHA-256 is one chain over the bytes, so the splits of a file follow each other. What goes
from a split's task to the next one's is the half-made digest, about a hundred bytes;
``hashlib`` cannot hand it out, the OpenSSL functions below it can. Splits are read as lines,
which Spark reads from parts of a file in any store (fixed records refuse a remainder); lines
and the breaks between them give the bytes back.
"""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks get this module's code with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Size of OpenSSL's SHA256_CTX, a flat struct: hash, bit count, block and two counters.
STATE_BYTES = 112
# Hadoop's line reader drops this mark from the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"

# A half-made digest: SHA256_CTX, bytes so far, start of the last line's split (-1: no line yet).
Chain = tuple[bytes, int, int]
CHAIN = "file_no int, state binary, n_bytes long, last long"


def openssl() -> ctypes.CDLL | None:
    """The OpenSSL library that ``hashlib`` uses, if it is one with SHA-256 by struct."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Init, library.SHA256_Update, library.SHA256_Final  # noqa: B018
    except (ImportError, AttributeError, OSError):
        return None
    return library


def updated(state: bytes, n_bytes: int, data: bytes) -> tuple[bytes, int]:
    context = ctypes.create_string_buffer(state, STATE_BYTES)
    openssl().SHA256_Update(context, data, ctypes.c_size_t(len(data)))
    return context.raw, n_bytes + len(data)


def begun(head: bytes) -> Chain:
    context = ctypes.create_string_buffer(STATE_BYTES)
    openssl().SHA256_Init(context)
    return *updated(context.raw, 0, head), -1


def ended(state: bytes) -> str:
    context, digest = ctypes.create_string_buffer(state, STATE_BYTES), ctypes.create_string_buffer(32)
    openssl().SHA256_Final(digest, context)
    return digest.raw.hex()


def literal_path(path: str) -> str:
    """The path for a reader, with the characters of patterns escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _carried_on(file_no: int, chain: Chain) -> Callable:
    """For ``mapInArrow`` over ``(line, start of its split)``: a file's chain after these lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n_bytes, last = chain
        for batch in batches:
            starts = batch.column(1).to_numpy()
            if len(starts) == 0:
                continue
            if starts[0] < last or (starts[1:] < starts[:-1]).any():
                raise RuntimeError("splits of a file are out of order")
            # A line follows the break of the line before it, but for the file's first.
            lines = b"\n".join(batch.column(0).to_pylist())
            state, n_bytes = updated(state, n_bytes, lines if last < 0 else b"\n" + lines)
            last = int(starts[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([file_no], pa.int32()), pa.array([state]), pa.array([n_bytes]), pa.array([last])],
            names=["file_no", "state", "n_bytes", "last"],
        )

    return run


def _mark(spark: SparkSession, path: str) -> bytes:
    """The byte order mark, if the file begins with it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop_path)
    try:
        return BYTE_ORDER_MARK if bytes(stream.readNBytes(3)) == BYTE_ORDER_MARK else b""
    finally:
        stream.close()


def is_compressed(spark: SparkSession, path: str) -> bool:
    """Whether line readers would unpack the file, as they do by its name."""
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path(path)) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(literal_path(path))
    return lines.select(F.col("value").cast("binary"), F.col("_metadata.file_block_start"))


def chained_sha256(spark: SparkSession, files: Sequence[tuple[str, int]]) -> list[str]:
    """SHA-256 of files given as ``(path, length)``.

    All files go on together: job k has a task for the k-th split of each. A task reads one
    split (``spark.sql.files.maxPartitionBytes``) and the rest of its last line; only half-made
    digests pass the driver. Stretches without a line break are held as one line, of under 2 GB.
    """
    sc = spark.sparkContext
    chains = [begun(_mark(spark, path)) for path, _ in files]
    lines = [_lines(spark, path) for path, _ in files]
    counts = [df.rdd.getNumPartitions() for df in lines]
    for k in range(max(counts)):
        going = [i for i, count in enumerate(counts) if k < count]
        steps = [lines[i].mapInArrow(_carried_on(i, chains[i]), CHAIN).rdd for i in going]
        firsts = accumulate((counts[i] for i in going), initial=0)
        at = [first + k for first, _ in zip(firsts, going, strict=False)]
        for file_no, state, n_bytes, last in sc.runJob(sc.union(steps), list, at):
            chains[file_no] = bytes(state), n_bytes, last
    digests = []
    for (state, n_bytes, _), (path, length) in zip(chains, files, strict=True):
        if n_bytes == length - 1:
            state, n_bytes = updated(state, n_bytes, b"\n")
        if n_bytes != length:
            raise RuntimeError(f"read {n_bytes} of the {length} bytes of {path}")
        digests.append(ended(state))
    return digests
