import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["component", "n"] and df.count() >= 0


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", ["block_lcs", "sequence_ratio", "greedy_cluster", "first_touch_cluster_sweep", "sorted_neighbour_url"])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_number_tokens_are_taken_from_whole_texts(spark, tmp_path):
    rows = [(1, "x " * 300 + "77 88", "en"), (2, "y " * 300 + "77 88", "en"), (3, "z " * 300 + "99", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id_1"]: (r["num_1"], r["nb_in_name"], r["num_in_name"]) for r in QUERIES["number_tokens_agreement_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: (7788, 0, 3), 2: (7788, -3, -2)}


def test_digits_are_taken_from_whole_texts(spark, tmp_path):
    rows = [(1, "a 1111111111 " + "x " * 2000 + "5550001234", "en", "s"), (2, "b 3333333333 " + "y " * 2000 + "5550001234", "en", "s"), (3, "same words at the start 9", "en", "s"), (4, "same words at the start 8", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("sorted_neighbour_digits_whole", "bucket_pairs_capped_whole"):
        assert [(r["id_1"], r["id_2"]) for r in QUERIES[name](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_near_names_of_a_point_with_many_places(spark, tmp_path):
    rows = [(i * 200, "même nom", "fr", "s") for i in range(460)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["near_names"](spark, str(tmp_path)).count() == 460 * 459 // 2
