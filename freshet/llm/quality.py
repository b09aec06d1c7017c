"""Quality rules with thresholds that follow each language and source.

Signals of every whole text are measured once. Mergeable KLL sketches of each signal per
(language, source) give the quartiles; the sketches are merged by language and over all rows too.
The quartiles of a group of n texts count n / (n + `prior_rows`), those of its language the rest,
which in turn lean on those of all rows, so nothing jumps at some size. A joined filter drops
texts beyond the fences.

Defined cases: a null text counts as empty; null language or source form groups of their own;
repeated rows are judged one by one; an empty table gives an empty result; further columns are
left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.arrow_text import mix, shingle_hashes, slices, text_bytes, words
from freshet.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _in_any_window(repeated: np.ndarray, starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Marks the words of `n` that lie inside a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[repeated], 1)
    np.add.at(edge, starts[repeated] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: pa.Array, width: int = 5) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    raw, bounds = text_bytes(texts)
    found = words(texts)
    n = len(bounds) - 1

    def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    inside = (raw & 0xC0 != 0x80) & (raw != 32) & ~((raw >= 9) & (raw <= 13))
    out = {
        "n_words": np.diff(found.bounds).astype(np.int64),
        "word_chars": per_text(inside, bounds),
        "n_symbols": per_text(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), bounds),
    }

    # Windows that a text has twice: sort the hashes of (text, window) and compare neighbours.
    rolled, at = shingle_hashes(found.hashes(), found.bounds, width)
    owner = np.repeat(np.arange(n), np.diff(at))
    keyed = mix(rolled + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    starts = np.arange(len(keyed)) + np.repeat(found.bounds[:-1] - at[:-1], np.diff(at))
    order = np.argsort(keyed)
    same = keyed[order[1:]] == keyed[order[:-1]]
    twice = np.zeros(len(keyed), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = _in_any_window(twice, starts, len(found.codes), width)
    out["n_repeat_words"] = per_text(covered, found.bounds)

    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = lines.flatten()
    line_owner = lines.value_parent_indices().to_numpy()
    filled = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    line_owner, codes = line_owner[filled], codes[filled]
    key = line_owner.astype(np.int64) * (len(flat) + 1) + codes
    kept = np.bincount(np.unique(key) // (len(flat) + 1), minlength=n)
    out["n_lines"] = np.bincount(line_owner, minlength=n).astype(np.int64)
    out["n_dup_lines"] = out["n_lines"] - kept
    return out


def measured(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """One row per document: `keys` and its COUNTS."""
    slim = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keys).schema] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                counts = measure(part.column(len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(counts[c], pa.int64()) for c in COUNTS)], [*keys, *COUNTS]
                )

    return slim.mapInArrow(run, schema)


#: Texts that the quartiles of a wider group count as beside a group's own.
PRIOR_ROWS = 20.0


@dataclass(frozen=True)
class Fence:
    """Keeps `signal` within quartiles -/+ `reach` times their distance, which is at least `least`."""

    signal: str
    reach: float
    least: float
    low: bool = False
    high: bool = True


FENCES = (
    Fence("symbol_ratio", 4.0, 0.02),
    Fence("word_length", 4.0, 0.5, low=True),
    Fence("dup_line_ratio", 4.0, 0.1),
    Fence("repeat_ratio", 4.0, 0.05),
)


def signals() -> dict[str, Column]:
    """Ratios of the counts; a text without words or lines has none (null)."""
    def ratio(a: str, b: str) -> Column:
        return F.col(a) / F.when(F.col(b) > 0, F.col(b))

    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "word_length": ratio("word_chars", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }


def thresholds(
    counts: DataFrame, groups: tuple[str, str] = ("lang", "source"), fences: tuple[Fence, ...] = FENCES, prior_rows: float = PRIOR_ROWS
) -> DataFrame:
    """Per (language, source): the fences `<signal>_low` and `<signal>_high`.

    Quartiles of a group are blended with those of its language, and these with those of all rows:
    n texts that have the signal weigh n against `prior_rows` of the wider quartile. Sketches
    are partial aggregates, so a hot source moves as one sketch per task.
    """
    first, second = groups
    named = [f.signal for f in fences]
    measures = signals()
    base = counts.groupBy(first, second).agg(*(F.kll_sketch_agg_double(measures[s]).alias(s) for s in named))

    def merged(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.kll_merge_agg_double(s).alias(f"{s}{tag}") for s in named))

    by_first = merged(base, [first], "_1").withColumnRenamed(first, "_first")
    # One row of a few KB, whatever the size of the input: the sketches of all rows.
    total = by_first.groupBy().agg(*(F.kll_merge_agg_double(f"{s}_1").alias(s) for s in named)).first()
    joined = base.join(by_first, base[first].eqNullSafe(by_first["_first"]), "left")

    def blended(sketches: list[Column], q: float) -> Column:
        """Quantile of the first sketch, leaning on that of the others, which are ever wider."""
        n = F.coalesce(F.kll_sketch_get_n_double(sketches[0]), F.lit(0)).cast("double")
        own = F.kll_sketch_get_quantile_double(F.when(n > 0, sketches[0]), F.lit(q))
        if len(sketches) == 1:
            return own
        wider = blended(sketches[1:], q)
        return F.when(n > 0, (own * n + wider * prior_rows) / (n + prior_rows)).otherwise(wider)

    columns = []
    for f in fences:
        sketches = [F.col(f.signal), F.col(f"{f.signal}_1"), F.lit(total[f.signal]).cast("binary")]
        q1, q3 = (blended(sketches, q) for q in (0.25, 0.75))
        spread = F.greatest(q3 - q1, F.lit(f.least)) * f.reach
        columns.append((q1 - spread if f.low else F.lit(None).cast("double")).alias(f"{f.signal}_low"))
        columns.append((q3 + spread if f.high else F.lit(None).cast("double")).alias(f"{f.signal}_high"))
    return joined.select(first, second, *columns)


def judge(
    docs: DataFrame, base_failed: Column | None = None, groups: tuple[str, str] = ("lang", "source"),
    fences: tuple[Fence, ...] = FENCES, prior_rows: float = PRIOR_ROWS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: `key`, COUNTS, `groups`, `base_failed`, `beyond` (signals out of bounds), `kept`.

    `base_failed` is a condition on COUNTS that rejects a text whatever its group is like.
    """
    counts = cut_lineage(measured(docs, text, (key, *groups)))
    bounds = thresholds(counts, groups, fences, prior_rows)
    bounds = bounds.withColumnsRenamed({g: f"_{g}" for g in groups})
    same = [counts[g].eqNullSafe(bounds[f"_{g}"]) for g in groups]
    joined = counts.join(bounds, same, "left")
    measures = signals()
    out = [
        F.when(
            (measures[f.signal] < F.col(f"{f.signal}_low")) | (measures[f.signal] > F.col(f"{f.signal}_high")), F.lit(f.signal)
        )
        for f in fences
    ]
    failed = F.lit(False) if base_failed is None else base_failed
    return joined.select(
        key, *groups, *COUNTS, failed.alias("base_failed"), F.array_compact(F.array(*out)).alias("beyond")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0))


def filter_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The kept rows of `docs` with all their columns; rows that share a key need all to be kept."""
    key = str(options.get("key", "doc_id"))
    refused = judge(docs, **options).where(~F.col("kept")).select(F.col(key).alias("_refused")).distinct()
    return docs.join(refused, docs[key].eqNullSafe(refused["_refused"]), "left_anti")
