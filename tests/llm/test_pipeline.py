"""The pipeline stage by stage against plain Python, on planted cases."""

import random
import re

import corpus_pipeline as cp
from freshet.llm import pii
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_jaccard import brute as duplicates
from tests.llm.test_packing import check as check_bins


def tables(spark, folder):
    rng = random.Random(9)
    vocab = [f"term{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [(k, f"{prose(60)}. {prose(40)}") for k in range(200)]
    bad = {k for k in range(0, 200, 5)}
    rows = [(k, f"{t} {prose(5)} scumbag{k % 3} idiot." if k in bad else t) for k, t in rows]
    item = prose(30)
    rows += [(300, rows[1][1]), (301, rows[2][1] + " one more"), (302, item + " " + prose(50)), (303, prose(30) + " mail me@x.example.org 10.0.0.1"), (304, None), (305, ""), (306, prose(9000))]
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in bad)) for k in range(200) if k % 4], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), bad, item


def test_stages_take_effect(spark, tmp_path):
    rows, bad, item = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, str(tmp_path))
        if name == "packing":
            break
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(after) == set(before) - bad
        elif name == "near_duplicates":
            want = duplicates(list(before.items()))
            assert set(after) == {c for _, c, _ in want} and 300 not in after and 301 not in after
        elif name == "decontamination":
            hit = {k for k, *_, c in contamination(list(before.items()), [(1, item)]) if c}
            assert hit == {302} and set(after) == set(before) - hit
        else:
            anchors = pii.automaton()
            assert after == {k: t and pii.masked(t, pii.spans(t, anchors)) for k, t in before.items()}
            assert "<EMAIL>" in after[303] and "<IP>" in after[303]
            assert {r.doc_id: r.n_chars for r in docs.collect()} == {k: len(t or "") for k, t in after.items()}
    lengths = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for k, t in before.items()}
    packed = docs.collect()
    check_bins(packed, lengths, 4096)
    key = lambda r: (r.doc_id, r.piece, r.length)
    assert sorted(map(key, cp.run(spark, str(tmp_path)).collect())) == sorted(map(key, packed))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
