"""Line deduplication: lines that several documents share stay in one of them only.

Texts are exploded into lines; a line is known by a 128-bit hash of its normal form (white space
stripped at both ends, A-Z lower-cased). Distinct documents are counted per hash, and lines of
hashes that enough documents hold are dropped everywhere but in the document of the least key.
What is left is put together by position.

Texts are cut into lines once; only hashes, keys and positions are written and shuffled for the
counts, and each text moves once, to meet the positions that it loses. Documents per hash are counted
by (hash, key) first and then by partial sums, so a line that a third of all documents carry is no
task of its own. Lines with more than one part in `HOT_PARTS` of all shared rows, fewer than
that many by this rule, meet their rows by broadcast, the others by hash. No list is longer than the lines of one text.

Defined cases: a null or empty text is one empty line and stays as it is; rows that share a key
are one document, each row keeping its own positions; a null key is a document of its own that
comes after all others; lines that repeat inside a document stay together or go together; an empty
table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: white space that is stripped from a line.
SPACE = " \t\n\x0b\x0c\r"
#: A shared line with more than one part in so many of all rows of shared lines is hot.
HOT_PARTS = 10_000


def line_key(line: Column) -> Column:
    """Normal form of a line: stripped, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hash_pair(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes; the leading literal seeds the second."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def line_hashes(rows: DataFrame, least_chars: int) -> DataFrame:
    """(_key, _row, _at, _h1, _h2): the lines of `rows` (_key, _row, _lines) with keys of `least_chars` or more."""
    lines = rows.select("_key", "_row", F.posexplode("_lines").alias("_at", "_line"))
    keyed = lines.select("_key", "_row", "_at", line_key(F.col("_line")).alias("_form")).where(F.char_length("_form") >= least_chars)
    first, second = hash_pair(F.col("_form"))
    return keyed.select("_key", "_row", "_at", first.alias("_h1"), second.alias("_h2"))


def shared_lines(hashes: DataFrame, least_docs: int) -> DataFrame:
    """(_h1, _h2, _keeper, _rows): hashes in `least_docs` documents or more, with the least key that holds each."""
    held = hashes.groupBy("_h1", "_h2", "_key").agg(F.count(F.lit(1)).alias("_each"))
    counted = held.groupBy("_h1", "_h2").agg(F.min("_key").alias("_keeper"), F.count("_each").alias("_docs"), F.sum("_each").alias("_rows"))
    return counted.where(F.col("_docs") >= least_docs).drop("_docs")


def kept_elsewhere(hashes: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of `hashes` whose line stays in another document. `shared` has been written."""
    total = shared.agg(F.sum("_rows")).first()[0] or 0
    is_hot = F.col("_rows") * HOT_PARTS > total
    hot = F.broadcast(shared.where(is_hot).drop("_rows"))
    few = hashes.join(hot, ["_h1", "_h2"], "left_anti").join(shared.where(~is_hot).drop("_rows"), ["_h1", "_h2"])
    return hashes.join(hot, ["_h1", "_h2"]).unionByName(few).where(~F.col("_key").eqNullSafe(F.col("_keeper")))


def drop_shared_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10, least_docs: int = 2,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """`docs` with the kept lines as `text`, and the columns `n_lines` (before) and `n_dropped`.

    Lines whose normal form has fewer than `least_chars` code points always stay.
    """
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    slim = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_row"), split.alias("_lines"))
    hashes = cut_lineage(line_hashes(slim, least_chars))
    shared = cut_lineage(shared_lines(hashes, least_docs))
    lost = (
        kept_elsewhere(hashes, shared)
        .groupBy(F.col("_key").alias("_of"), F.col("_row").alias("_of_row")).agg(F.collect_set("_at").alias("_lost"))
    )
    # The lines stand for the text, so it moves once; the flag tells a null from an empty text.
    others = [c for c in docs.columns if c not in (text, n_lines, n_dropped)]
    whole = docs.select(
        F.struct(*(F.col(_quoted(c)) for c in others)).alias("_doc"), F.col(text).isNull().alias("_null"),
        F.col(key).alias("_key"), F.xxhash64(text).alias("_row"), split.alias("_lines"),
    )
    met = whole.join(lost, whole["_key"].eqNullSafe(lost["_of"]) & (whole["_row"] == lost["_of_row"]), "left")
    lines = F.col("_lines")
    # Set operations and places in an array keep this linear in the lines of a text.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("_lost", F.array().cast("array<int>")))
    kept = F.when(~F.col("_null"), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).alias(text)
    return met.select(
        *(kept if c == text else F.col(f"_doc.{_quoted(c)}") for c in docs.columns if c not in (n_lines, n_dropped)),
        F.size(lines).cast("long").alias(n_lines), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias(n_dropped),
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
