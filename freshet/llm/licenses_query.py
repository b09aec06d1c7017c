"""op6: licence of every document by canonical digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.licenses import (
    AHEAD, ARTICLES, BETWEEN_WORDS, CLAUSE_NOUNS, CLAUSE_WORDS, KNOWN, NO_NOTICE, SIGN, SPELLINGS, known_licenses, scan, whole_texts,
)
from freshet.llm.registry import query, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelled_sql(form: str) -> str:
    for old, new in SPELLINGS:
        padded = [" " + w.replace(" ", "  ") + " " for w in (old, new)]
        form = f"replace({form}, '{padded[0]}', '{padded[1]}')"
    return form


def _holder_sql(line: str) -> str:
    """Whether a line names a holder of rights, without looking ahead: what follows its signs is cut out and tested by itself.

    A sign that a letter follows is part of a word; a mark keeps it from being read as one.
    """
    marked = f"regexp_replace({line}, '({SIGN})([a-z])', chr(1) || '\\1\\2', 'g')"
    rest = f"replace(regexp_replace({marked}, '^{AHEAD}(copyright|\\(c\\))([ \\t:-]*({SIGN}))*', ''), chr(1), '')"
    clause = f"^[ \\t:-]*((({CLAUSE_WORDS})|{ARTICLES} {CLAUSE_NOUNS})([^a-z0-9]|$)|{ARTICLES} *$)"
    return (
        f"(regexp_matches({line}, '^{AHEAD}©') OR (regexp_matches({marked}, '^{AHEAD}(copyright|\\(c\\))')"
        f" AND NOT regexp_matches({rest}, {_quoted('^(' + NO_NOTICE + ')')}) AND NOT regexp_matches({rest}, '^[ \\t]*$')"
        f" AND NOT regexp_matches({rest}, {_quoted(clause)})))"
    )


def _lines_sql(text: str) -> str:
    each = f"string_split(lower(coalesce({text}, '')), chr(10))"
    bare = f"array_to_string(list_transform({each}, lambda line: CASE WHEN {_holder_sql('line')} THEN '' ELSE line END), chr(10))"
    words = f"regexp_replace({bare}, {_quoted(BETWEEN_WORDS)}, '  ', 'g')"
    return _spelled_sql(f"(' ' || replace({words}, chr(10), ' ' || chr(10) || ' ') || ' ')")


def _plain_sql(form: str) -> str:
    return f"trim(replace({form}, '  ', ' '))"


def _whole_sql(text: str) -> str:
    return _plain_sql(_spelled_sql(f"regexp_replace({_lines_sql(text)}, '[ \\n]+', '  ', 'g')"))


SQL = f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license) AS license
  FROM (SELECT license, {_whole_sql("text")} AS form
        FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, _, t in [*KNOWN, *whole_texts()])}) v(license, text))
  WHERE form <> '' GROUP BY 1),
whole AS (
  SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS license_digest
  FROM (SELECT doc_id, {_whole_sql("text")} AS form FROM documents)),
lines AS (SELECT doc_id, unnest(string_split({_lines_sql("text")}, chr(10))) AS line FROM documents),
found AS (
  SELECT DISTINCT l.doc_id, k.license
  FROM (SELECT doc_id, {_plain_sql("line")} AS form FROM lines) l JOIN known k ON l.form <> '' AND sha256(l.form) = k.digest),
notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM found GROUP BY doc_id)
SELECT w.doc_id, w.license_digest, k.license, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.license_digest = k.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
"""


@query("op6_license_digests", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))
