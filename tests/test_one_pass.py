import pytest

from biblioflow.plans import queries
from biblioflow.plans.process import characterise, citations, summaries, with_summary


@pytest.mark.parametrize("name", ["reference_only", "document_summaries"])
def test_documents_are_characterised_once(spark, name):
    """Normal forms are taken once of documents and once of entries; summaries are picked by a third function. A second reading of the documents would join."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 3 and plan.count("Join") == 0


def test_one_pass_says_what_the_join_says(spark):
    refs = "Abbot, R. T., & Obi, S. (1990). Adaptive sampling of forest growth. Harbour Geoscience, 12(3), 4-9. https://doi.org/10.1234/p1\n"
    prose = "We walked along the river and wrote down what the people there had told us about the weather that day.\n"
    texts = ["References\n" + refs * 3, prose * 20 + "References\n" + refs * 2, prose * 9, "", None, "References\n" + refs + prose * 2 + "\n\nand so on, without an end"]
    base = characterise(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"))
    columns = ("doc", "kind", "citation_count", "discarded_count", "summary")
    want = with_summary(base, citations(base, ["doc"]), ["doc"]).withColumn("kind", base["detection.kind"]).select(*columns)
    got = summaries(base, ["doc"]).select(*columns)
    rows = sorted(want.collect())
    assert sorted(got.collect()) == rows and len(rows) == len(texts) and {r.kind for r in rows} >= {"bibliography", "research_paper", "non_academic", "unknown"}


def test_modes_without_an_override_share_a_plan(spark):
    plan = queries.QUERIES["detect_modes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") == 3
