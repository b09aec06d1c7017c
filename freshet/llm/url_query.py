"""op7: verdict on every page url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.registry import query, table
from freshet.llm.url_graph import Rule, judge_pages

RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)


@query("op7_host_trust")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), RULES, domains=True)
