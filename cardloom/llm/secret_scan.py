"""Secret scan: known patterns, and literals assigned to names that sound secret."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

# The base patterns and the least lengths of their findings.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# Equal to taking maximal runs and leaving out the short ones.
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}

SENSITIVE = re.compile(
    r"passw(?:or)?d|passphrase|pwd|secret|token|api_?key|private_?key|access_?key|auth_?key|credential|signing_?key",
    re.IGNORECASE | re.ASCII,
)
_ASSIGNMENT = re.compile(
    # A name begins where no name goes on before it, so that a long run is read once.
    r"""(?P<quote>["']?)(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)(?P=quote)[ \t]*(?::=|=>|[:=])(?!=)[ \t]*"""
)
_PART = re.compile(r"""(?P<q>["'`])(?P<string>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<bare>[A-Za-z0-9+/_.=$-]+)""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|\|\|)?[ \t]*(?=[\"'`])")
_PLACEHOLDER = re.compile(r"x+|\*+|changeme|example|none|null|true|false|your.*|<.*|\$\{?\w+.*", re.IGNORECASE)


def _bits(text: str) -> float:
    """Entropy of the characters, bits each."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _score(name: str, value: str) -> float:
    """0 to 1: how surely ``value`` is a secret, given the name it is assigned to."""
    if not SENSITIVE.search(name) or len(value) < ASSIGN_LEAST or _PLACEHOLDER.fullmatch(value):
        return 0.0
    kinds = sum(map(bool, (re.search(p, value) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))))
    return min(1.0, 0.2 + 0.1 * kinds + 0.1 * _bits(value) + 0.01 * min(len(value), 20))


def literal_spans(text: str, threshold: float = 0.6) -> list[tuple[int, int]]:
    """Spans of literals whose target name and randomness reach ``threshold``.

    Statements ``name = value``, ``name: value``, ``name := value`` and ``"name" => value``
    are lexed; a value is a quoted string, several joined ones, a bare word or another
    name. Names stand for the literals last given to them, so that a constant's literal is
    found when it is passed on to a name that sounds secret.
    """
    known: dict[str, list[tuple[int, int, str]]] = {}
    found = set()
    at = 0
    while m := _ASSIGNMENT.search(text, at):
        at, parts = m.end(), []
        while part := _PART.match(text, at):
            at = part.end()
            if part["bare"] is not None:
                bare = part["bare"]
                parts += known.get(bare, []) or [(part.start("bare"), part.end("bare"), bare)]
            else:
                parts.append((part.start("string"), part.end("string"), part["string"]))
            joint = _JOIN.match(text, at)
            if part["bare"] is not None or not joint or joint.end() == at:
                break
            at = joint.end()
        if parts:
            known[m["name"]] = parts
            if _score(m["name"], "".join(p[2] for p in parts)) >= threshold:
                found.update((start, end) for start, end, _ in parts)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings; offsets are code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _named(spans) -> str:
    names = list(KINDS)
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches):
    for batch in released(batches):
        counts, bases, spans = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            more = literal_spans(text) if ":" in text or "=" in text else []
            counts.append([sum(kind == k for _, kind, _ in base) for k in range(3)])
            bases.append(_named(base))
            spans.append(_named(sorted([*base, *((start, 3, end) for start, end in more)])))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns, pa.array(bases, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) for every row of ``docs``.

    ``base`` and ``spans`` list kind:start:end by start, then kind (assign, access, hex,
    literal), comma-joined; offsets are code points of the whole text. ``spans`` adds the
    literals found by lexing. A null text is empty; repeated rows are scanned each; other
    columns are ignored. One pass over each text, nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
