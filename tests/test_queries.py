"""Every registered query against its SQL at the smallest scale; the build; plans."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from cardloom.operators.clustering import ClusterConfig
from cardloom.plans.build import BuildConfig, build_all, build_labels, build_report, find_similar
from cardloom.plans.demo_cards import demo_cards
from cardloom.sources.tables import read_table

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def comparable(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[column]) and frame[column].dtype != bool:
            frame[column] = frame[column].astype("float64").round(6)
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(map(str, r)) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    expected = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert comparable(got) == comparable(expected)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["primary_label", "count"]


def test_build(spark, tmp_path):
    out = str(tmp_path / "out")
    small = ClusterConfig(n_clusters=5, n_components=4, n_init=2)
    build_all(demo_cards(spark, SF_DIR), out, BuildConfig(clusters=small))
    n = demo_cards(spark, SF_DIR).count()
    labels = read_table(spark, f"{out}/card_labels")
    assert labels.count() == n and labels.filter("cluster is null").count() == 0
    report = read_table(spark, f"{out}/cluster_report").collect()
    assert sum(r.cluster_size for r in report) == n
    reps = read_table(spark, f"{out}/cluster_representatives").collect()
    for row in report:
        mine = sorted((r.representative_rank, r.centroid_distance) for r in reps if r.cluster == row.cluster)
        assert [k for k, _ in mine] == list(range(1, min(10, row.cluster_size) + 1))
        assert [d for _, d in mine] == sorted(d for _, d in mine)
        assert len(row.representative_cards) == len(mine) and len(row.top_terms) <= 15
    near = find_similar(spark, out, "blue BOLT", 4).collect()
    assert len(near) == 4 and near[0].score >= near[-1].score
    with pytest.raises(LookupError):
        find_similar(spark, out, "no such card")
    build_report(spark, out, BuildConfig(clusters=small, space="normalized"))
    unit = read_table(spark, f"{out}/cluster_representatives")
    assert unit.filter("centroid_distance > 2").count() == 0
    build_labels(spark, out, clusters=False)
    assert read_table(spark, f"{out}/card_labels").filter("cluster is not null").count() == 0


def physical_plan(spark, name):
    return contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["card_labels", "labels_long", "similar_to_doc", "tfidf_transform", "cluster_top_terms"]
)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = physical_plan(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("name", ["term_frequencies", "labels_long", "primary_label_counts"])
def test_expensive_columns_are_not_copied_into_filters(spark, name):
    filters = [line for line in physical_plan(spark, name).splitlines() if "Filter " in line]
    assert not any("regexp_extract_all" in f or "RLIKE" in f for f in filters)


@pytest.mark.parametrize("name", ["cluster_top_terms", "cluster_top_items", "cluster_representatives"])
def test_top_n_is_limited_before_the_shuffle(spark, name):
    assert physical_plan(spark, name).count("WindowGroupLimit") == 2
