"""The ranked search of the query against its SQL where items repeat."""

import duckdb

from faultline.llm import queries


def test_rows_of_one_item_id_are_one_item(spark, tmp_path):
    docs = [(i, f"w{i % 7} w{i % 5} the {'w3 ' * (i % 3)}") for i in range(60)] + [(100, None), (101, "..."), (102, "w1")]
    items = [(1, "w1 the"), (1, "w3 W3"), (2, "w2"), (2, "w2"), (2, None), (3, None), (3, "w4-w5"), (4, None), (5, "w1"), (None, "w6"), (None, "w0")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_ranked(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()
    with duckdb.connect() as base:
        for name in ("documents", "benchmark"):
            base.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        wanted = base.execute(queries.ORACLES["op11_ranked"]).fetchall()
    assert len({(r.item_id, r.rank) for r in got}) == len(got)
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
