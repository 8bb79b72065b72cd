"""Fill-in-middle, exact dedup, filter audit: brute force, round trips, odd rows, both sides of size switches."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm import exact_dedup, fill_in_middle, filter_audit

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # Names that the operators use inside.
    *[T.StructField(x, T.StringType()) for x in ("row", "id", "h", "n", "form", "output", "chars", "sha", "kept", "part", "mask", "digest")],
])
LONG = "Wörter und 🦆 " * 30_000


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 12) for r in rows], DOCS)


def rows_of(seed=3, n=120):
    rng = random.Random(seed)
    texts = ["", "a b", "ab", "a  b", "\ta\x0bb\n", "A B", "é à 🦆", "x<P>y", "<S", "<M>", "#1", "THE END", " \n ", LONG, " " + LONG]
    rows = [(i * 37 % n, rng.choice([*texts, None]), rng.choice(["en", "fr", None])) for i in range(n)]
    rows += [rows[5], rows[5], (None, "a b", "en"), (None, "a b", "en"), (None, None, None), (7, "a b", None), (-4, "a   b", "en")]
    rows += [(1000 + i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(150, 400))), "fr") for i in range(40)]
    rows += [(2000 + i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.randint(150, 400))), "en") for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def data():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data).repartition(7)


def test_units_against_code_points():
    rng = random.Random(2)
    for size in (0, 1, 7, 8, 9, 63, 200):
        texts = ["".join(rng.choice("aé漢🦆") for _ in range(rng.randint(0, size))) for _ in range(5)]
        whole = "".join(texts)
        data = np.frombuffer(whole.encode(), dtype=np.uint8)
        units = fill_in_middle.Units(data)
        ends = np.cumsum([len(c.encode()) for c in whole], dtype=np.int64)
        assert units.select(np.arange(1, len(whole) + 1)).tolist() == ends.tolist()
        assert units.select(np.zeros(2, dtype=np.int64)).tolist() == [0, 0]
        offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
        assert np.diff(units.rank(offsets)).tolist() == [len(t) for t in texts]


def expected_cut(doc_id, text):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle(docs, data):
    out = fill_in_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    expected = [(i, *expected_cut(i, t), t or "") for i, t, _ in data]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, expected))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_rates(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    share = lambda **k: dict(fill_in_middle.fill_in_middle(many, **k).groupBy("form").count().collect())
    usual = share()
    assert 300 < usual["plain"] < 500 and 600 < usual["spm"] < 840
    assert share(plain_percent=0, spm_percent=100) == {"spm": 4000}
    assert share(seed=2) != usual


def brute_exact(data):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in data]
    groups = {}
    for (i, t, _), x in zip(data, norm):
        groups.setdefault(x, []).append((-len(t or ""), i is None, i))
    out = []
    for (i, t, _), x in zip(data, norm):
        best = min(groups[x], key=lambda k: (k[0], k[1], k[2] or 0))
        out.append((i, best[2], len(groups[x]), hashlib.sha256(x.encode()).hexdigest(), (-len(t or ""), i is None, i) == best))
    return out


def check_exact(got, data):
    expected = brute_exact(data)
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(key(e[:4]) for e in expected)
    best = {key((e[0], e[3])) for e in expected if e[4]}
    kept = [key((r.doc_id, r.text_sha256)) for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got}) and set(kept) == best


@pytest.mark.parametrize("bucket_keys, broadcast", [(8192, 2_000_000), (2, 2_000_000), (2, 0)])
def test_exact_dedup(monkeypatch, docs, data, bucket_keys, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", broadcast)
    check_exact(exact_dedup.exact_duplicates(docs, bucket_keys).collect(), data)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_exact_dedup_chains_texts_whose_keys_collide(monkeypatch, docs, data, broadcast):
    """With keys of a few values every key has a chain, and hot and cold texts share keys."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", broadcast)
    hashed = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(hashed(*c), F.lit(5)))
    check_exact(exact_dedup.exact_duplicates(docs).collect(), data)


def test_exact_dedup_hot_text_and_empty_table(spark, docs):
    many = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text").otherwise(F.concat(F.lit("t"), F.expr("id div 2"))).alias("text")
    )
    data = [(r.doc_id, r.text, None) for r in many.collect()]
    check_exact(exact_dedup.exact_duplicates(many, 64).collect(), data)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_keeps_rows(docs, data):
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted(
        {(str(i), t or "") for (i, t, _), e in zip(data, brute_exact(data)) if e[4]}
    )


def test_directory_splits_overfull_buckets_only(spark):
    # Half of the keys begin with the same six bits.
    keys = spark.range(4000).select(F.xxhash64("id").alias("h")).withColumn(
        "h", F.when(F.col("h") % 2 == 0, F.shiftrightunsigned("h", 6)).otherwise(F.col("h"))
    )
    cells, bits = exact_dedup.directory(keys, 100)
    placed = keys.withColumn("cell", exact_dedup._prefix(bits)).join(cells, "cell")
    sizes = {r.bucket: r["count"] for r in placed.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 100
    # Buckets in thin ranges keep their width: several entries point to one.
    widths = [r["count"] for r in cells.groupBy("bucket").count().collect()]
    assert min(widths) == 1 and max(widths) > 8


def brute_audit(data, labels):
    first = {}
    for i, t, _ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang in data:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        least = first.get(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": least is not None and (i is None or i > least),
        }
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, rows, shares = [d for d in docs if d[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, before = [d for d in left if d[1][x]], left
                left = [d for d in left if not d[1][x]]
                shares[x] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone),
                             sum(d[1][x] for d in mine) - sum(d[1][x] for d in before),
                             sum(d[1][x] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*r, shares[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_filter_audit(spark, docs, data):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 2100, 3)] + [(6, 1, 1), (6, 0, None), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit_filters(docs, frame).collect())
    assert got == brute_audit(data, [x for x in labels if x[0] is not None])
    assert filter_audit.audit_filters(docs.limit(0), frame).count() == 0
    assert filter_audit.audit_filters(docs, frame.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_counts_words_of_long_texts_in_slices(monkeypatch):
    text = (LONG + " one  two\n" * 50).encode()
    whole = filter_audit.word_counts(text)
    for size in (5, 64, 1000):
        monkeypatch.setattr(filter_audit, "_SLICE", size)
        assert filter_audit.word_counts(text) == whole == (len(text.split()), len(set(text.split())))
