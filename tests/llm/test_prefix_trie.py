"""The trie against nested dictionaries, with sketches that prove much, little and nothing."""

import hashlib
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from freshet.llm import prefix_trie, prefix_trie_query

SCHEMA = "conv_id long, turn long, role string, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def conversations(rows):
    """{conv: [(role, text)]} in the documented order."""
    def order(row):
        _, turn, role, text = row
        role, text = role or "", text or ""
        a = signed(xxhash.xxh64_intdigest(text.encode(), signed(xxhash.xxh64_intdigest(role.encode(), 42)) & (1 << 64) - 1))
        return (turn is not None, turn or 0, role, a)

    out = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        out.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return out


def rebuild(convs):
    def rest(c):
        return c % 5 if c >= 0 else -(-c % 5)

    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - rest(c), [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []

    def below(node):
        got = [below(x) for x in children.get(node, [])]
        leaves = sum(g[0] for g in got) if got else 1
        saved = sum(g[1] for g in got) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children.get(node, [])),
            leaves, saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
        return leaves, saved

    if members:
        below(())
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def make_rows(n, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.1:
            continue
        base = rng.choice([0, 0, 0, 1, 2, c])
        for t in range(rng.choice([0, 1, 2, 3, 8, 14])):
            own = base if t < rng.choice([2, 5, 20]) else f"{c}"
            rows.append((c, rng.choice([t, t, None]) if c % 11 == 0 else t, rng.choice(["user", None]) if c % 13 == 0 else "user", rng.choice([None, "", "ünï"]) if c % 17 == 0 else f"turn {t} of {own}"))
    return rows + rows[:3] + [(None, 1, "user", "nobody")]


@pytest.mark.parametrize("most", [1 << 16, 8])
def test_equals_nested_dictionaries(spark, monkeypatch, most):
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", 8 if most == 8 else 1 << 16)
    rows = make_rows(150, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.lit(1)).withColumn("conv", F.lit("x")).repartition(3)
    got = prefix_trie.prefix_trie(df, most_cells=most)
    assert result(got) == brute(conversations(rows))
    assert (got.where("local").count() > 0) == (most > 8)
    turns = prefix_trie_query.rebuilt(prefix_trie.ordered_turns(df))
    assert result(prefix_trie.trie_nodes(turns, most)) == brute(rebuild(conversations(rows)))


def test_large_group_of_copies_long_conversation_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)] + [(1000, t, "user", f"same {t}") for t in range(4000)] + [(1001, 0, "a" * 10, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(prefix_trie.prefix_trie(df)) == [x for x in brute_long(conversations(rows))]
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0


def brute_long(convs):
    """`brute` for deep tries: recursion replaced by sums over members."""
    members = {}
    for c, turns in convs.items():
        key = hashlib.sha256()
        members.setdefault(key.digest(), (0, []))[1].append((c, None))
        for d, turn in enumerate(turns, 1):
            parent = key.digest()
            key.update(repr(turn).encode())
            members.setdefault(key.digest(), (d, []))[1].append((c, parent))
    least = {k: min(c for c, _ in m) for k, (_, m) in members.items()}
    kids, size = {}, {}
    for k, (d, m) in members.items():
        if d:
            kids.setdefault(m[0][1], []).append(k)
            size[k] = len(convs[m[0][0]][d - 1][1].encode())
    leaves, saved = {}, {}
    for k, (d, m) in sorted(members.items(), key=lambda x: -x[1][0]):
        leaves[k] = sum(leaves[x] for x in kids[k]) if k in kids else 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + (len(m) - 1) * size.get(k, 0)
    out = []
    for k, (d, m) in members.items():
        ends = ",".join(str(c) for c, _ in sorted(m) if len(convs[c]) == d)
        out.append((least[k], d, least[m[0][1]] if d else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_sketch_never_counts_too_low(spark):
    df = spark.range(20_000).select(F.xxhash64(F.col("id") % 15_000).alias("p1"), F.xxhash64(F.lit(1), F.col("id") % 15_000).alias("p2"))
    bits = prefix_trie.count_min(df, 1 << 16)
    twice = df.groupBy("p1", "p2").count().where("count > 1").toPandas()
    at = prefix_trie.cells(twice["p1"].to_numpy(), twice["p2"].to_numpy(), 1 << 16)
    assert len(twice) == 5000 and all((bits[int(c) >> 3] >> (7 - (int(c) & 7))) & 1 for c in at.ravel())
