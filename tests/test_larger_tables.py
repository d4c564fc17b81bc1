"""Queries on tables with what only larger ones have: near ties, deeper trees, common names."""

import os

import duckdb

from lorekeep.operators import aggregates
from lorekeep.plans import registry
from lorekeep.plans.search import VECTOR
from tests.parity import TABLES, connect, differences

registry.load()
SF = "/root/testdata/sf0.001"


def tables(folder, **made) -> str:
    """A folder with the given tables (SQL) and all others as they are."""
    for t in TABLES:
        if t in made:
            duckdb.execute(f"COPY ({made[t]}) TO '{folder}/{t}.parquet'")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def same(spark, name, sf):
    return differences(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLE_SQL[name]) == []


def test_vectors_whose_rounded_cosines_are_equal(spark, tmp_path):
    near = ", ".join(f"CAST({v} AS FLOAT)" for v in VECTOR[1:])
    sf = tables(tmp_path, embeddings=f"SELECT i AS vec_id, [CAST({VECTOR[0]} + (30 - i) * 0.001 AS FLOAT), {near}] AS embedding, 1 AS label FROM range(30) r(i)")
    assert same(spark, "vector_top", sf)


def test_texts_whose_rounded_ranks_are_equal(spark, tmp_path):
    sf = tables(tmp_path, documents="SELECT i AS doc_id, repeat('tion hand ', CAST(2000 + i AS INTEGER)) AS text, 'en' AS lang, 'a' AS source, CAST(10 AS BIGINT) AS n_chars FROM range(40) r(i)")
    assert same(spark, "full_text_top", sf)


def test_tree_of_more_levels_than_the_sql(spark, monkeypatch):
    """Five digits: the SQL ends with the 16 nodes that four levels leave."""
    monkeypatch.setattr(aggregates, "LEAF_ROWS", 0.002)
    sql = registry.ORACLE_SQL["order_fingerprint"].replace("64.0", "0.002")
    got = registry.QUERIES["order_fingerprint"](spark, SF)
    assert got.count() == 16 and differences(got, connect(SF), sql) == []


def test_texts_are_decoded_once(spark):
    plan = registry.QUERIES["secrets_in_documents"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(sequence") == 1


def test_function_words_are_counted_without_lambdas(spark):
    plan = registry.QUERIES["function_word_ratios"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan


def test_nearest_vectors_meet_in_blocks(spark, monkeypatch):
    """Small blocks, as of many vectors; ties, NULL and zero vectors; against all pairs."""
    monkeypatch.setattr(aggregates, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(aggregates, "QUERY_BLOCK", 3)
    vec = lambda i: None if i == 5 else [0.0, 0.0] if i == 6 else [float(i % 4 + 1), 2.0]
    v = spark.createDataFrame([(i, vec(i)) for i in range(40)], "id long, embedding array<float>")
    got = {(r.query_id, r.rank, r.found_id) for r in aggregates.nearest_of_all(v, v.filter("id % 8 = 0"), 3, "id", 5).collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 5)
    rest = lambda q: sorted((-cos(vec(q), vec(i)), i) for i in range(40) if i not in (q, 5, 6))[:3]
    assert got == {(q, k + 1, i) for q in range(0, 40, 8) for k, (_, i) in enumerate(rest(q))}
