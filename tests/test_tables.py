"""Sources, guards, joins, counts, ranking and samples."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import joins, project, ranking, stats
from cardloom.operators.text_tables import enriched_cards, oracle_tokens, type_features
from cardloom.operators.tfidf import TfidfConfig, fit_transform
from cardloom.plans.build import build_text_tables
from cardloom.sources import ingest, tables

CARDS = [
    {"id": "b", "name": "Fire", "released_at": "2020-01-02", "type_line": "Creature — Elf",
     "oracle_text": "Fire burns.", "cmc": 2, "colors": ["R"], "legalities": {"x": "legal"},
     "power": "*", "extra": 1},
    {"id": "a", "name": None, "type_line": None, "oracle_text": None},
]


def write_json(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_read_cards(spark, tmp_path):
    cards = tables.read_cards(spark, write_json(tmp_path / "cards.json", CARDS))
    assert cards.columns == list(project.CORE_COLUMNS)
    fire = cards.filter("id = 'b'").first()
    assert (str(fire.released_at), fire.cmc, fire.power) == ("2020-01-02 00:00:00", 2.0, "*")
    assert fire.colors == ["R"] and fire.legalities == {"x": "legal"} and fire.oracle_id is None
    with pytest.raises(project.MissingInput, match="nowhere"):
        tables.read_cards(spark, str(tmp_path / "nowhere.json"))


def test_text_tables_tolerate_absent_columns(spark):
    core = spark.createDataFrame(
        [("x", "Fire", "Creature — Elf", "Fire: draw a card.")],
        "id string, name string, type_line string, oracle_text string",
    )
    assert type_features(core).first().oracle_id is None
    assert oracle_tokens(core).first().oracle_tokens == ["this", "card", "draw_a_card"]
    row = enriched_cards(core).first()
    assert (row.basic_types, row.sub_types) == (["Creature"], ["Elf"])
    assert row.oracle_text_norm == "this card: draw a card."
    with pytest.raises(project.MissingInput, match="oracle_text"):
        enriched_cards(core.drop("oracle_text"))
    assert project.core_projection(core.withColumn("zz", F.lit(1))).columns == [
        "id", "name", "type_line", "oracle_text",
    ]


def test_ingest(spark, tmp_path):
    entries = [
        {"type": "rulings", "download_uri": "u0", "updated_at": "2020-01-01T00:00:00"},
        {"type": "cards", "download_uri": "u1", "updated_at": "2024-05-06T07:08:09"},
        {"type": "cards", "name": "later", "download_uri": "u2", "updated_at": "2025"},
    ]
    catalogue = write_json(tmp_path / "catalogue.json", {"data": entries})
    info = ingest.bulk_info(spark, catalogue, "cards").first()
    assert info[:] == ("cards", "cards", "u1", "2024-05-06T07:08:09", "cards_20240506T070809.json")
    with pytest.raises(project.MissingInput, match="other"):
        ingest.bulk_info(spark, catalogue, "other")

    write_json(tmp_path / info.saved_as, CARDS)
    out = str(tmp_path / "out")
    target = ingest.ingest_bulk(spark, catalogue, "cards", str(tmp_path), out, force=False)
    assert tables.read_table(spark, target).count() == 2
    write_json(tmp_path / info.saved_as, CARDS[:1])
    assert ingest.ingest_bulk(spark, catalogue, "cards", str(tmp_path), out, force=False) == target
    assert tables.read_table(spark, target).count() == 2
    ingest.ingest_bulk(spark, catalogue, "cards", str(tmp_path), out)
    assert tables.read_table(spark, target).count() == 1
    manifest = spark.read.json(f"{out}/manifest").collect()
    assert len(manifest) == 2 and manifest[0].saved_as == info.saved_as


def test_ingest_survives_a_crash_at_every_step(spark, tmp_path, monkeypatch):
    entry = {"type": "cards", "download_uri": "u1", "updated_at": "2024"}
    catalogue = write_json(tmp_path / "catalogue.json", {"data": [entry]})
    write_json(tmp_path / "cards_2024.json", CARDS)
    out = str(tmp_path / "out")
    run = lambda **k: ingest.ingest_bulk(spark, catalogue, "cards", str(tmp_path), out, **k)
    rows = lambda: [r.saved_as for r in ingest.manifest(spark, out).collect()]

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # data in place, no manifest row
        m.setattr(ingest, "_enter_in_manifest", crash)
        with pytest.raises(OSError):
            run()
    with pytest.raises(project.MissingInput):
        rows()
    target = run(force=False)
    assert rows() == ["cards_2024.json"] and tables.read_table(spark, target).count() == 2
    run(force=False)
    assert rows() == ["cards_2024.json"]
    with monkeypatch.context() as m:  # while writing: the version stays as it is
        m.setattr(ingest, "bulk_info", lambda *_: spark.createDataFrame([("cards_2024.json",)], "saved_as string").withColumn("x", F.raise_error(F.lit("lost"))))
        with pytest.raises(Exception, match="lost"):
            run()
    assert tables.read_table(spark, target).count() == 2 and len(rows()) == 1
    run()
    assert rows() == ["cards_2024.json"] * 2


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    got = {r.file_name: (r.file_bytes, r.sha256) for r in ingest.file_checksums(spark, str(tmp_path)).collect()}
    assert got == {
        "a.bin": (3, hashlib.sha256(b"abc").hexdigest()),
        "b.bin": (0, hashlib.sha256(b"").hexdigest()),
    }


def test_checksums_split_by_split(spark, tmp_path):
    rng = random.Random(3)
    noise = rng.randbytes(9_500)
    mark = b"\xef\xbb\xbf"
    contents = {
        "noise.bin": noise, "ends.bin": noise + b"\n", "mark.bin": mark + noise, "marks.bin": mark * 2 + b"\r\n" + noise,
        "breaks.bin": b"\n" * 7_000, "no break.bin": b"\x00" * 7_000, "lines.bin": b"\r\n\n\xff" * 1_800,
        "a[1]{b}%20.bin": noise[::-1], "_hidden.bin": noise, "packed.gz": gzip.compress(noise),
        "one.bin": b"x", "line.bin": b"\n", "mark only.bin": mark, "empty.bin": b"",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items() if n[0] != "_")
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for whole_bytes in (0, 7_100):
            got = ingest.file_checksums(spark, str(tmp_path), whole_bytes=whole_bytes)
            assert sorted(map(tuple, got.collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_checksum_tasks_read_a_split(spark, tmp_path, monkeypatch):
    data = random.Random(4).randbytes(400_000)
    (tmp_path / "long.bin").write_bytes(data)
    read = []

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    run_job = spark.sparkContext.runJob

    def counted(rdd, function, partitions):
        got = run_job(rdd, function, partitions)
        read.append((len(partitions), got[0][2]))
        return got

    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    monkeypatch.setattr(spark.sparkContext, "runJob", counted)
    try:
        [row] = ingest.file_checksums(spark, str(tmp_path), whole_bytes=100_000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert row.sha256 == hashlib.sha256(data).hexdigest()
    steps = [n - m for (_, n), (_, m) in zip(read, [(1, 0), *read[:-1]], strict=True)]
    assert len(steps) == 8 and max(steps) < 55_000


def test_output_checks(spark, tmp_path):
    root = str(tmp_path / "out")
    assert ingest.missing_outputs(spark, root).count() == len(ingest.EXPECTED_OUTPUTS)
    for name in ("cards_core", "models/svd/components", "card_labels"):
        tables.write_table(spark.range(3), f"{root}/{name}")
    missing = {r.output for r in ingest.missing_outputs(spark, root).collect()}
    assert missing == set(ingest.EXPECTED_OUTPUTS) - {"cards_core", "models/svd", "card_labels"}
    with pytest.raises(project.MissingInput, match="cluster_report"):
        ingest.require_outputs(spark, root)
    quality = ingest.table_quality(
        {"one": spark.range(2), "none": spark.range(0)}, {"one": ["id", "gone"], "none": ["id"]}
    )
    assert {r.table_name: r[1:] for r in quality.collect()} == {
        "one": (2, False, False), "none": (0, True, False),
    }


def test_vector_artifacts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "id int, text string")
    model, weights = fit_transform(docs, TfidfConfig(min_df=1, max_df=1.0))
    tables.save_vectors(model, weights, docs, str(tmp_path / "v"))
    again, stored, ids = tables.load_vectors(spark, str(tmp_path / "v"))
    assert (again.n_docs, again.n_terms) == (model.n_docs, model.n_terms)
    assert sorted(stored.collect()) == sorted(weights.collect())
    assert sorted(r.id for r in ids.collect()) == [1, 2, 3]


def test_malformed_cards_raise(spark, tmp_path):
    cut_off = tmp_path / "cut.json"
    cut_off.write_text('[{"id": "a", "name": "x", "cmc": 1.0}, {"id": "b", "na')
    wrong = tmp_path / "wrong.json"
    wrong.write_text('[{"id": "a", "name": "x", "cmc": "many"}]')
    for path in (cut_off, wrong):
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
            tables.read_cards(spark, str(path)).collect()


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, v int")
    right = spark.createDataFrame([("b", 9, "x"), ("c", 8, "y")], "id string, v int, w string")
    got = joins.left_join_suffixed(left, right, ["v", "w"], "_r").collect()
    assert sorted(got, key=str) == sorted(
        [("a", 1, None, None), ("b", 2, 9, "x"), ("b", 3, 9, "x")], key=str
    )
    assert joins.join_clusters(left, None).schema["cluster"].dataType.simpleString() == "int"
    clusters = spark.createDataFrame([("a", 5)], "id string, cluster int")
    assert sorted(r.cluster or 0 for r in joins.join_clusters(left, clusters).collect()) == [0, 0, 5]
    found = joins.lookup_with_default(left, clusters, "cluster", -1)
    assert sorted((r.id, r.cluster) for r in found.collect()) == [("a", 5), ("b", -1), ("b", -1)]
    rows = spark.createDataFrame([("a", 0), ("z", 1)], "id string, matrix_row int")
    with pytest.raises(ValueError, match="joined 1 rows, row map has 2"):
        joins.aligned_join(left, rows)


def test_filters(spark):
    frame = spark.createDataFrame(
        [(3, "Old"), (1, None), (2, "OLD"), (4, "new")], "id int, name string"
    )
    assert project.first_match(frame, "old").first().id == 2
    assert project.where_name_is(frame, "").first().id == 1
    with pytest.raises(LookupError, match="gone"):
        project.first_match(frame, "gone")
    assert project.where_in(frame, "name", ["new", "Old"]).count() == 2
    assert project.where_equal(frame, "name", "new").count() == 1
    assert project.drop_nulls(frame, "name").count() == 3
    assert project.fill_text(frame, "name").filter("name = ''").count() == 1


def test_counts(spark):
    frame = spark.createDataFrame(
        [("b", 1.5, ["x", "y"]), ("a", 2.5, []), ("b", None, ["x"]), (None, 0.5, None), ("a", -0.5, [])],
        "k string, v double, l array<string>",
    )
    assert [r[:] for r in stats.value_counts(frame, "k").collect()] == [("a", 2), ("b", 2)]
    assert [r[:] for r in stats.value_counts(frame, "k", 1).collect()] == [("a", 2)]
    assert [r[:] for r in stats.item_counts(frame, "l", "i").collect()] == [("x", 2), ("y", 1)]
    assert [r[:] for r in stats.whole_number_histogram(frame, "v").collect()] == [(0, 2), (2, 2)]
    assert [r[:] for r in stats.null_share(frame, 2).collect()] == [("k", 0.2), ("l", 0.2)]
    assert stats.key_uniqueness(frame, "k").first()[:] == (5, 2, False)
    assert stats.shape(frame).first()[:] == (5, 3)
    assert stats.value_range(frame, "v").first()[:] == (-0.5, 2.5)
    assert stats.distinct_count(frame, "k", approximate=True).first()[0] == 2
    assert stats.size_summary(frame, "k").first()[:] == (2, 2.0, 0.0, 2, 2.0, 2.0, 2.0, 2)
    assert [r[:] for r in stats.size_rank(frame, "k").collect()] == [("a", 2, 1), ("b", 2, 2)]


def test_row_index(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    indexed = ranking.with_row_index(frame.repartition(7), "k").collect()
    assert all(r.row_index == r.k for r in indexed) and len(indexed) == 1000
    both = ranking.with_row_index(frame, F.desc("g"), F.asc("k")).orderBy("row_index").collect()
    assert [(r.g, r.k) for r in both] == sorted(((r.g, r.k) for r in both), key=lambda t: (-t[0], t[1]))
    assert [r.row_index for r in both] == list(range(1000))


def test_head_tail_and_groups(spark):
    frame = spark.range(20).withColumn("g", F.col("id") % 2)
    assert [r.id for r in ranking.head(frame, 3, "id").collect()] == [0, 1, 2]
    assert [r.id for r in ranking.tail(frame, 3, "id").collect()] == [17, 18, 19]
    top = ranking.top_per_group(frame, "g", [F.desc("id")], 2).collect()
    assert sorted((r.g, r["rank"], r.id) for r in top) == [(0, 1, 18), (0, 2, 16), (1, 1, 19), (1, 2, 17)]


def test_samples(spark):
    frame = spark.range(5000)
    drawn = [r.id for r in ranking.seeded_sample(frame, 40, 1).collect()]
    assert len(set(drawn)) == 40
    assert drawn == [r.id for r in ranking.seeded_sample(frame.repartition(9), 40, 1).collect()]
    assert drawn != [r.id for r in ranking.seeded_sample(frame, 40, 2).collect()]
    by_hash = sorted(range(5000), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
    assert drawn == by_hash[:40]
    assert ranking.capped_sample(frame, 6000, 1).count() == 5000
    assert ranking.capped_sample(frame, 70, 1).count() == 70


def test_sides_of_joins_lie_in_partitions_of_bounded_rows(spark):
    cards = spark.range(100).select(F.concat(F.lit("c"), F.col("id")).alias("id"))
    numbered = spark.range(90, 110).select(F.concat(F.lit("c"), F.col("id")).alias("id"), F.col("id").alias("n"))
    left, right = joins.dealt(cards, numbered, rows=30)
    assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() == 4
    joined = joins.left_join(left, right, ["n"]).collect()
    assert len(joined) == 100 and {r.id: r.n for r in joined if r.n is not None} == {f"c{i}": i for i in range(90, 100)}


def test_card_tables_lie_in_files_of_few_rows(spark, tmp_path):
    """One file in, several tasks' worth of files out, also where all rows have one key."""
    core = spark.range(60_000, numPartitions=1).select(
        F.lit("c").alias("id"), F.lit("n").alias("name"), F.lit("Creature").alias("type_line"), F.lit("Fly.").alias("oracle_text")
    )
    build_text_tables(core, str(tmp_path))
    stored = tables.read_table(spark, f"{tmp_path}/cards_core")
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) == 3 and max(sizes) <= 25_000
    assert tables.read_table(spark, f"{tmp_path}/cards_enriched").count() == 60_000


def test_a_frequent_term_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(400).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") - 299).cast("int").alias("term_idx"))
    rows.withColumn("weight", F.lit(0.5)).write.parquet(f"{tmp_path}/weights")
    tables.save_postings(tables.read_table(spark, f"{tmp_path}/weights"), f"{tmp_path}/postings", 100)
    stored = tables.read_table(spark, f"{tmp_path}/postings")
    assert stored.count() == 400 and stored.select("parts").distinct().collect()[0].parts == 4
    files = stored.filter("term_idx = 0").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(f["count"] for f in files) < 150
