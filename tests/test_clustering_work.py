"""Texts are read once and stay where they are: what clustering and scoring move is their keys."""

from pyspark.sql import functions as F

from nichelens.operators import clustering as clu
from nichelens.operators import topics as sco
from nichelens.plans import document_queries as dq
from nichelens.plans import domain as d

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_urls_of_their_own_give_the_same_signatures(spark):
    urls = d.item_urls(spark, SF)
    apart = clu.build_signatures(d.items_without_pages(spark, SF), dq.RULES, urls)
    whole = clu.build_signatures(d.items(spark, SF), dq.RULES)
    assert sorted(apart.columns) == sorted(whole.columns)
    assert apart.select(*whole.columns).exceptAll(whole).isEmpty() and whole.count() == apart.count() > 0
    assert plan(apart).count("ArrowEvalPython") == 1


def test_rows_without_id_have_no_signature(spark):
    items = d.items(spark, SF).limit(3).withColumn("item_id", F.lit(None).cast("bigint"))
    assert clu.build_signatures(items, dq.RULES).isEmpty()


def test_a_run_writes_what_is_asked_for(spark):
    run = dq.Clustered(spark, SF)
    assert run.matched[1].columns and not {"members", "clusters"} & set(vars(run))
    again = clu.cluster_items(run.signatures, rules=dq.RULES)
    assert run.members.exceptAll(again).isEmpty() and run.members.count() == again.count()


def test_judgements_meet_scores_not_texts(spark):
    clusters = dq.clustered(spark, SF).clusters
    got = plan(sco.score_clusters(clusters, d.NOW, dq.verdicts(spark, SF), dq.TOPICS).select("cluster_key", "score"))
    assert got.index("Join LeftOuter") < got.index("ArrowEvalPython")
    assert "canonical_summary" not in dq.scored_clusters(spark, SF).columns
