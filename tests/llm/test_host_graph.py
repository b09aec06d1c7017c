"""Host edges by domains and links, and verdicts that come from propagated mass."""

from pyspark.sql import functions as F

from freshet.llm import catalog  # noqa: F401
from freshet.llm import url_graph
from freshet.llm.registry import QUERIES
from freshet.llm.url_query import RULES


def test_edges_of_domains_and_all_links(spark):
    rows = [
        (1, "http://a.b.x.org/", "<a href=//p.org/1><a href=https://q.org/2>"), (2, "http://c.x.org/", '<a href="//p.org/"><a href="/p.org">'),
        (3, "http://10.0.0.1/", None), (4, "http://10.0.0.1:80/", ""), (5, "http://x.org/", "<a href='http://q.org/'>"), (6, "http://" + "l." * 200 + "org/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.src, r.dst): r.weight for r in url_graph.host_edges(pages, domains=True).collect()}
    kin = [("a.b.x.org", "b.x.org"), ("b.x.org", "x.org"), ("c.x.org", "x.org")]
    want = {e: 0.5 if b == "x.org" else 1.0 for a, b in kin for e in ((a, b), (b, a))}
    want |= {("a.b.x.org", "p.org"): 1.0, ("a.b.x.org", "q.org"): 1.0, ("c.x.org", "p.org"): 1.0, ("x.org", "q.org"): 1.0}
    assert got == want


def test_given_pages_have_edges_and_propagated_verdicts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert url_graph.host_edges(pages, domains=True).count() > 0
    rows = QUERIES["op7_host_trust"](spark, sf_dir).collect()
    assert len(rows) == pages.count()
    ruled = {r.host for r in rows if r.rule}
    reached = [r for r in rows if r.rule is None and r.host not in ruled and r.trust + r.distrust > 0]
    assert reached
    assert all(r.verdict == "allow" for r in reached if r.trust >= r.distrust)
    assert "block" in {r.verdict for r in reached}


def test_every_ruled_page_is_evidence(spark):
    """A third of the pages of one host and a fifth of another are blocked: both are seeds, by their counts."""
    rows = [("http://a.net/fr/1",)] * 2 + [("http://a.net/en/",)] * 4 + [("http://b.net/es/",)] + [("http://b.net/",)] * 4 + [("http://c.com/",), (None,)]
    judged = spark.createDataFrame(rows, "url string").select(url_graph.url_host(F.col("url")).alias("host"), url_graph.url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("_by_rule", url_graph.match_rules(F.col("host"), F.col("path"), RULES))
    seeds = {r.host: (r.trust, round(r.distrust, 9)) for r in url_graph.host_seeds(judged).collect()}
    assert seeds == {"a.net": (0.0, round(2 / 3, 9)), "b.net": (0.0, round(1 / 3, 9)), "c.com": (1.0, 0.0)}
