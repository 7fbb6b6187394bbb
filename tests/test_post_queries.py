"""What the queries hand to the operators of posts."""

from nichelens.plans import document_queries


def test_fact_line_query_names_no_product(spark, monkeypatch):
    clusters = spark.createDataFrame([("k", "enkeit", "372", None, "OTHER")], "cluster_key string, vendor string, product string, version string, event_type string")
    run = type("Run", (), {"clusters": clusters})
    monkeypatch.setattr(document_queries, "clustered", lambda spark, sf_dir: run)
    assert document_queries.fact_line(spark, "").first()["fact"] == "Enkeit сообщил об обновлении."
