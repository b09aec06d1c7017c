"""op13: trie of rebuilt conversations, which take their first turns from the head of their group of five."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.prefix_trie import ordered_turns, trie_nodes, with_roots
from freshet.llm.registry import query, table

GROUP, HEADS = 5, 9

SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT conv_id, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: list_transform(range(0, 8),
           lambda j: (ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT >> j::INT) & 1))) AS bits
  FROM (SELECT DISTINCT conv_id FROM turns)),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bits),
           lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 9 AS h
  FROM bits),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.role, t.txt FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.role, t.txt FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, strlen(txt) AS bytes,
         string_agg(sha256(length(role) || ':' || role || txt), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix
  FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, left(prefix, 64 * (depth::INT - 1)) AS parent,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM ended GROUP BY prefix, depth),
children AS (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent = n.prefix),
above AS (
  SELECT left(prefix, 64 * k::INT) AS prefix, n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted)),
below AS (SELECT prefix, sum(leaf::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.prefix = n.prefix LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.parent
"""


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns with roots where conversation c begins with the first h turns of c - c % 5; h is a hash of c.

    Own turns and borrowed ones keep their places, which differ; the heads are at most eight turns
    of every fifth conversation.
    """
    def heads(conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % HEADS

    convs = turns.select("conv").distinct()
    own = turns.where(F.col("pos") > heads(F.col("conv")))
    first = turns.where((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "_from")
    # Negative ids count towards zero, as the remainder does.
    step = F.when(F.col("_from") < 0, F.lit(-1)).otherwise(F.lit(1))
    reach = F.when(F.col("_from") == 0, F.sequence(F.lit(1 - GROUP), F.lit(GROUP - 1))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda k: k * step))
    lent = first.select("*", F.explode(reach).alias("_k")).withColumn("conv", F.col("_from") + F.col("_k"))
    lent = lent.where(F.col("pos") <= heads(F.col("conv"))).join(convs, "conv", "left_semi").select(turns.columns)
    return with_roots(own.unionByName(lent), convs)


@query("op13_prefix_trie", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(rebuilt(ordered_turns(table(spark, sf_dir, "conversations")))).drop("local")
