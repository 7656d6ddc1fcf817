import duckdb
import pytest

from spanweave.llm import queries


def test_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    for n in (1, 2, 3, 4, 6, 7, 8, 9):
        assert any(q.startswith(f"p{n}_") for q in queries.queries())


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p3_balance", "p4_found", "p4_groups", "p4_document_groups", "p6_found", "p6_neighbours", "p8_found", "p9_found", "p9_classes"])
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("abalone", "anuran_calls", "mushroom", "reuters", "sample_targets", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = queries.queries()[name](spark, data)
    columns = sorted(got.columns)
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())


def test_documents(spark, data):
    ids = {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, data).collect()}
    assert len(ids) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert queries.p8_found(spark, data).columns == ["doc_id", "item_id"] and queries.p9_found(spark, data).columns == ["doc_id_a", "doc_id_b"]
