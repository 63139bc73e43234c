import pytest

from biblioflow.llm import _queries, url_filter

#: The contract's list: what each rule says of a host of its own, of a subdomain, and of the whole length of its path.
CONTRACT = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def test_rules_are_the_contracts():
    assert url_filter.RULES == CONTRACT


@pytest.mark.parametrize("at", range(len(CONTRACT)))
def test_query_says_what_each_rule_says(spark, tmp_path, at):
    verdict, host, path = CONTRACT[at]
    rows = [(1, f"http://{host}{path}", ""), (2, f"https://a.{host.upper()}{path}x?q#f", ""), (3, f"http://x{host}{path}", ""), (4, f"http://{host}/other", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in _queries.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == (host + path, verdict)
    assert got[4] == (None, "allow") and got[3][0] != host + path


def test_allowed_net_alias_is_inherited(spark):
    rows = [(1, "http://a.io/", '<link rel="canonical" href="http://b.net/de/9">'), (2, "http://c.io/", '<link rel="canonical" href="http://d.example.net/de/8">')]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block"}
