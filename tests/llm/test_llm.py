"""The training-data operators on small tables: brute force, edge cases, SQL."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from cardloom.llm import (
    ann, chat, decontaminate, language_id, licenses, line_dedup, mixing, queries, secret_scan, simhash, substring_dedup,
)
from cardloom.llm.components import components

SF_DIR = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use inside.
    *[T.StructField(x, T.StringType()) for x in ("row", "id", "h", "fp", "number", "spans", "items", "k", "start", "size")],
])


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *["x"] * 10) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a row null throughout."""
    long = " ".join(f"word{k % 5000} and the number {k}" for k in range(40_000))
    lines = "A first line that is long enough\nshort\nA second line that is long enough"
    rows = [
        (1, lines, "en", "a"), (1, lines, "en", "a"), (2, lines, "en", None), (3, None, "en", "a"), (4, "", None, "b"),
        (None, "une ligne de texte assez longue\n12345", "fr", "b"), (5, long, "en", "a"), (6, long, "en", "a"),
        (7, "... 123 !!!", None, "c"), (8, "È già tardi", "it", "c"),
    ]
    return table(spark, rows).union(spark.createDataFrame([(None,) * 15], DOCS))


@pytest.fixture(scope="module")
def random_docs():
    rng = random.Random(5)
    vocabulary = ["ab", "cd", "Ef", "gé", "hi", "jk"]
    passages = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(6)]
    out = []
    for i in range(60):
        words = [w for _ in range(rng.randint(0, 4)) for w in (
            rng.choice(passages)[rng.randint(0, 9) : rng.randint(12, 30)] if rng.random() < 0.5
            else [f"{rng.choice(vocabulary)}{rng.randint(0, 50)}" for _ in range(rng.randint(1, 20))])]
        out.append((i * 7 % 61, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    return out


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5)] + [(k, k + 1) for k in range(20, 60)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {k: 20 for k in range(20, 61)} | {k: 100 for k in range(100, 160)}
    assert got == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_fingerprint():
    words = ["Ab", "c", "dÉ", "c", "dÉ"]
    hashes = [xxhash.xxh64_intdigest(" ".join(w.replace("A", "a") for w in words[k : k + 3]).encode(), 42) for k in range(3)]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 1.5)
    assert simhash._fingerprint("Ab  c\tdÉ\nc dÉ") == expected
    assert simhash._fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash._fingerprint(None) == simhash._fingerprint(" \n") == 0
    text = " ".join(map(str, range(500)))
    assert simhash._fingerprint(text) == simhash._fingerprint(text, block=7)


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_simhash_links(spark, parts):
    rng = random.Random(parts)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r.u, r.v) for r in simhash.links(prints, 3, parts).collect()}
    near = {(max(a, b), min(a, b)) for a in values for b in values if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert got == near


def test_thresholds_cover_every_pair():
    p = np.full(64, 0.5)
    p[:20] = 0.02  # values of the first group coincide often: its threshold should be lower
    groups = [list(range(k, k + 16)) for k in range(0, 64, 16)]
    t = simhash.allocate_thresholds(p, 100_000, groups, 7)
    assert sum(x + 1 for x in t) == 8 and t[0] < max(t)


def test_line_dedup(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randint(20, 26))) for _ in range(12)]

    def edit(line):
        line = list(line)
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(line))
            line[k : k + 1] = rng.choice([[], ["x"], [line[k], "é"]])
        return "".join(line)

    docs = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(1, 4)))) for i in range(30)]

    def near(a, b, k):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= k

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (1, 2):
        lines = [(i, p, x.strip(" ").lower()) for i, t in docs for p, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= 20]
        gone = {(i, p) for i, p, x in lines if any((j, q) < (i, p) and near(x, y, k) for j, q, y in lines)}
        kept = {i: [x for p, x in enumerate(t.split("\n")) if (i, p) not in gone] for i, t in docs}
        got = {r.row.doc_id: r.kept_lines for r in line_dedup.dedup_lines(frame, 20, k).collect()}
        assert got == kept


def test_line_dedup_query_and_stage_take_two_edits(spark, tmp_path):
    text = ["Order 12 was shipped on a Monday", "Order 34 was shipped on a Monday", "Order 3456 was sent on a Monday"]
    spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_removed for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(text)])
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, SF_DIR).collect()} == {0: text[0], 1: "", 2: text[2]}


def test_decontaminate(spark, random_docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    items = [(k, " ".join(t.split()[k : k + 9 + k % 20])) for k, (_, t) in enumerate(random_docs) if t.split()[k:]]
    items += [(900, "jk"), (901, ""), (902, None), (None, "ab cd ef"), (900, "jk")]
    hits = decontaminate.benchmark_hits(
        spark.createDataFrame(random_docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    for r in hits.collect():
        w = words(r.row.text)
        covered, found = set(), set()
        for item, text in items:
            v = words(text)
            n = min(13, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams] if n else []
            covered |= {k + j for k in at for j in range(n)}
            found |= {item} if at and item is not None else set()
        assert {k for a, b in r.spans for k in range(a, b)} == covered and set(r["items"]) == found
    assert decontaminate.cut("A, b (c) d!", [[1, 3]]) == "A, ) d!"


def test_benchmark_in_blocks(spark, random_docs, odd, monkeypatch):
    docs = spark.createDataFrame(random_docs, "doc_id long, text string")
    items = spark.createDataFrame([*[(k, t) for k, t in random_docs[:20]], (None, "ab cd"), (900, None)], "item_id long, text string")

    def results():
        cut = decontaminate.benchmark_hits(docs, items, cutting=True).select("row.*", "spans", "clean")
        return [
            sorted(map(str, out.collect()))
            for out in (cut, decontaminate.contamination(docs, items), decontaminate.contamination(odd, items))
        ]

    whole = results()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert results() == whole
    assert decontaminate.decontaminate(odd.limit(0), items).count() == 0


def test_substring_dedup(spark, random_docs):
    first = {}
    for i, t in sorted(random_docs):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(spark.createDataFrame(random_docs, "doc_id long, text string")).collect()}
    assert len(got) == len(random_docs) and any(r.n_removed for r in got.values())
    for i, t in random_docs:
        w = t.split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert got[i].kept_text == " ".join(x for k, x in enumerate(w) if k not in gone) and got[i].n_removed == len(gone)


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_substring_dedup_with_repeats_in_a_document(spark, batch):
    """Passages and anchors that one document holds several times, its twin in another batch."""
    rng = random.Random(batch)
    fresh = lambda n: [f"n{rng.getrandbits(40)}" for _ in range(n)]
    passages, anchor = [fresh(20) for _ in range(4)], ["five", "words", "in", "many", "contexts"]
    contexts = [fresh(8) + anchor + fresh(8) for _ in range(12)]
    docs = [(0, fresh(9) + passages[0] + fresh(9)), (1, fresh(9) + passages[0] + fresh(7) + passages[0] * 2),
            (2, [w for c in contexts for w in c + fresh(3)]), *[(3 + k, fresh(4) + c + fresh(4)) for k, c in enumerate(contexts)]]
    docs += [(20 + k, [w for _ in range(6) for w in (rng.choice(passages + contexts) + fresh(rng.randint(0, 3)))]) for k in range(20)]
    first = {}
    for i, w in docs:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(7)
        got = {r.doc_id: r.kept_text for r in substring_dedup.dedup_passages(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, w in docs:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert got[i] == " ".join(x for k, x in enumerate(w) if k not in gone), i


def test_mix_targets_and_pieces(spark):
    rows = [(k, f"s{k % 7}" if k % 7 else None, (k * 37) % 90) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    placed, pieces = mixing.mix_pieces(frame, block=16)
    pieces = pieces.collect()
    quota = {r.k: r.quota for r in placed.select("k", "quota").distinct().collect()}
    size = {(r.k, r.start): r.size for r in placed.collect() if r.size}
    slots = [r.slot for r in pieces]
    for k in quota:
        assert sum(r["last"] - r["first"] for r in pieces if r.k == k) == quota[k]
    assert all(0 <= r["first"] < r["last"] <= size[r.k, r.start] for r in pieces)
    # Each slot is one block of one source.
    assert len({(r.slot, r.k) for r in pieces}) == len(set(slots))
    # Low discrepancy: any stretch of slots holds each source about in proportion.
    order = [k for _, k in sorted({(r.slot, r.k) for r in pieces})]
    top = max(quota, key=quota.get)
    share = order.count(top) / len(order)
    seen = np.cumsum([k == top for k in order])
    assert np.abs(seen - share * np.arange(1, len(order) + 1)).max() < 6


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1500, 8)).astype(np.float32)
    base[40:340] = base[0]  # a common vector
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    bad = [(5000, None), (5100, [0.0] * 8), (5200, [1.0, None] * 4), (5300, [float("nan")] * 8), (5400, [1.0, 2.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, frame.filter("vec_id % 100 = 0"), shard_rows=500, query_rows=7).toPandas()
    assert set(got.query_id) == {*range(0, 1500, 100)}
    exact, hits = base.astype(np.float64), 0
    for q, part in got.groupby("query_id"):
        dist = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(dist)), dist)) if i != q][:10]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 11)) and np.allclose(part.score, dist[part.vec_id])
        hits += len(set(order) & set(part.vec_id))
    assert hits / len(got) >= 0.95
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == [0, *range(40, 49)]


def test_license_scan(spark):
    filler = "x y z " * 30
    rows = [
        (1, filler + "Released under the MIT license. " + filler), (2, "LICENSED under the Apache License, version 2.0"),
        (3, "released under some other license"), (4, None), (5, ""),
        (6, filler + licenses.TEMPLATES["MIT/notice"].replace("restriction", "limits") + filler + "Licensed under CC BY-NC 4.0"),
    ]
    got = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k: r.licenses for k, r in got.items()}
    assert found == {1: ["MIT"], 2: ["Apache-2.0"], 3: [], 4: [], 5: [], 6: ["CC-BY-NC-4.0", "MIT"]}
    assert got[1].spans == "MIT:90:95" and "MIT/notice" in got[6].spans


def test_license_scan_tells_versions_apart(spark):
    """Templates that differ in a word or two: each text gets its own name only."""
    filler = "some other words that stand around it " * 9
    own = {name: text for name, text in licenses.TEMPLATES.items()}
    rows = [(k, filler + text + " " + filler) for k, text in enumerate(own.values())]
    both = f"{filler} {own['GPL-2.0/notice']} {filler} {own['AGPL-3.0/notice']} {own['GPL-3.0']} {filler}"
    got = {r.doc_id: r.licenses for r in licenses.find_licenses(
        spark.createDataFrame([*rows, (99, both)], "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(own))] == [[name.split("/")[0]] for name in own]
    assert got[99] == ["AGPL-3.0", "GPL-2.0", "GPL-3.0"]


def test_license_scan_finds_all_lines(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pattern = "Licensed under the Apache License|Released under the MIT License|GNU General Public License, version 3|Licensed under CC BY-NC"
    expected = {r.doc_id for r in docs.filter(F.col("text").rlike(pattern)).collect()}
    got = {r.doc_id for r in licenses.find_licenses(docs).filter("size(licenses) > 0").collect()}
    assert expected <= got and len(got) <= len(expected) + 1


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok <turn:user>\n\\b\\\\l"
    rows = [(1, 2, "user", "bye"), (1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", None), (2, 1, "assistant", "é😀"),
            (3, 0, None, "x"), (None, None, "user", ""), (4, 0, "a<>\\", "x"), (4, 0, "a<>\\", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.training_examples(frame)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", said), ("assistant", said), ("user", "bye")] and got[1].loss_text == said
    assert got[2].loss_text == "é😀" and [tuple(t) for t in got[3].turns] == [("", "x")]
    assert len(got) == 5 and len(got[4].turns) == 2 and got[4].turns[0].role == "a<>\\"
    replies = examples.filter("loss_start is not null").count()
    assert replies == 3 and examples.count() == 3 + 4


def test_language_id(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) and (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    rows = {r.doc_id: r for r in language_id.identify(odd).collect() if r.doc_id is not None}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (3, 4, 7)) and rows[8].lang_pred != "und"
    # The sample depends on the rows alone, not on their partitions.
    wide = language_id.fit(docs.repartition(9), per_language=20)
    narrow = language_id.fit(docs.coalesce(1), per_language=20)
    assert wide.langs == narrow.langs and np.array_equal(wide.lengths, narrow.lengths)
    # A prediction depends on the text alone, not on its batch.
    model = language_id.fit(docs)
    each = {r.row.doc_id: r.bits for r in language_id.predict(docs.repartition(7), model).collect()}
    assert each == {r.row.doc_id: r.bits for r in language_id.predict(docs.coalesce(1), model).collect()}


def test_secret_scan():
    text = 'K1 = "a8Fk29sdKq"\npassword = K1\nToken: abc\nAPIKEY="Zz9+/_.=-Q" ſecret=abcdefgh AKIA' + "A1" * 9 + " " + "0f" * 13
    base = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for a, k, b in base] == [
        (0, 'APIKEY="Zz9+/_.=-Q'), (1, "AKIA" + "A1" * 9), (2, "0f" * 13)]
    assert text[slice(*secret_scan.literal_spans(text)[0])] == "a8Fk29sdKq"
    assert secret_scan.literal_spans('token = "abcD1" + "efG2hZ9"') == [(9, 14), (19, 26)]
    assert secret_scan.literal_spans("password: changeme\nname = 'a8Fk29sdKq'") == []
    assert secret_scan.literal_spans("x=1 " + "a" * 500_000) == []  # read once, not from every letter


@pytest.mark.parametrize("operator", [
    lambda d: simhash.near_duplicates(d), lambda d: line_dedup.dedup_lines(d), lambda d: substring_dedup.dedup_passages(d),
    lambda d: mixing.mix_sources(d), lambda d: licenses.find_licenses(d), lambda d: language_id.identify(d),
    lambda d: secret_scan.find_secrets(d),
    lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(6)),
])
def test_odd_rows(spark, odd, operator):
    assert operator(odd).count() == odd.count()
    assert operator(odd.limit(0)).count() == 0


def test_odd_rows_in_the_pipeline(spark, odd):
    for docs in (odd, odd.limit(0)):
        counts = []
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns
                docs = out
            counts.append(out.count())
        assert counts == sorted(counts, reverse=True)


def test_empty_conversations_and_vectors(spark):
    assert chat.training_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, empty).count() == 0


def test_registered_ids(spark):
    assert [re.match(r"op\d+", n)[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_sha_of_kept_lines(spark):
    row = queries.op2_line_dedup(spark, SF_DIR).filter("n_removed = 0").first()
    text = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_lines_of_one_template_make_no_pairs(spark):
    from cardloom.llm import common

    rng = random.Random(5)
    words = ["".join(rng.choice("etanirsdlu") for _ in range(5)) for _ in range(60)]

    def variant(k):
        line = list(words)
        for _ in range(3):
            line[rng.randrange(60)] = f"{k:05d}"
        return " ".join(line)

    lines = [variant(k) for k in range(300)]
    # Near lines all alike, and two of the others' near copies, before and after them.
    lines += [" ".join(words[:40]) + f" {k % 10}{k // 10}" for k in range(100)] + [lines[7][1:], "x" + lines[250] + "y"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    tables = []

    def kept(df, name):
        tables.append((name, df.count()))
        return df.localCheckpoint()

    written, common.written = common.written, kept
    try:
        got = {r.row.doc_id for r in line_dedup.dedup_lines(docs).filter("n_removed > 0").collect()}
    finally:
        common.written = written
    assert got == {*range(301, 400), 400, 401}
    assert all(n <= 10 * len(lines) for _, n in tables)  # ten keys a line at most, not a row a pair
