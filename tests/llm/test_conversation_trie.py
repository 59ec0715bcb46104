"""The trie of conversations against one built of dictionaries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from convoke.llm import conversation_trie as M


def plainly(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaf = lambda s: not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in nodes)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == seq)
        children = sum(len(s) == len(seq) + 1 for s in below)
        saved = sum((len(nodes[s]) - 1) * words(s) for s in below)
        parent = min(nodes[seq[:-1]]) if seq else None
        out.append((min(members), len(seq), parent, len(members), children, sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def some(rng, n, longest, kinds, base=0):
    rows = []
    for c in rng.sample(range(base, base + 6 * n), n):
        for t in range(rng.randrange(1, longest + 1)):
            rows.append((c, t, rng.choice(["user", "bot", None]) if kinds > 1 else "user", rng.choice(["one", "two words", "", None, " three  of\tthem "][:kinds])))
    return rows


def got(spark, rows, chunk, parts):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted(map(repr, map(tuple, M.trie(df, chunk).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("chunk,parts,seed", [(2, 1, 1), (2, 5, 2), (3, 9, 3), (64, 1, 4), (64, 6, 5), (4, 13, 6)])
def test_against_dictionaries(spark, chunk, parts, seed):
    rng = random.Random(seed)
    rows = some(rng, 60, 9, 2) + some(rng, 25, 4, 5, 1000) + some(rng, 40, 6, 1, 2000)
    # One conversation many times over, one that is long, one without text, and rows without conversation.
    seen = {r[0] for r in rows}
    rows += [(c, t, "user", "same") for c in range(400, 460) if c not in seen for t in range(6)]
    rows += [(100_001 + c, t, "user", f"turn {t % 7}") for c in range(2) for t in range(40 - c)]
    rows += [(-5, None, None, None), (None, 1, "user", "nobody's"), (7000, 3, "a", "tie"), (7000, 3, "a", "tie"), (7000, None, "a", "first")]
    assert got(spark, rows, chunk, parts) == plainly(rows)


def test_few_rows(spark):
    assert got(spark, [(None, 1, "user", "x")], 64, 2) == []
    for rows in ([(3, 1, "user", "x y")], [(20, 1, "u", "x"), (20, 2, "u", "y"), (40, 1, "u", "x")], [(c, 0, "", "") for c in range(50)]):
        for chunk in (2, 64):
            assert got(spark, rows, chunk, 3) == plainly(rows)


def test_large_numbers_of_turns(spark):
    rows = [(60, t * 700, "user", f"{t}") for t in range(30)] + [(61, t, "user", f"{t}") for t in range(5)]
    assert got(spark, rows, 8, 4) == plainly(rows)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, "u", "x", "old", 5)], "conv_id long, turn long, role string, text string, depth string, k int")
    assert [r.depth for r in M.trie(df).orderBy("depth").collect()] == list(range(2 if zlib.crc32(b"1") % 4 == 0 else 1))


def test_nearest_smaller():
    rng = random.Random(9)
    for _ in range(300):
        values = [rng.randrange(-1, 5) for _ in range(rng.randrange(1, 30))]
        left, right, same = M.nearest_smaller(values)
        for i, v in enumerate(values):
            first = same[i]
            assert values[first] == v and all(x >= v for x in values[first : i + 1])
            assert left[first] == max([j for j in range(i) if values[j] < v], default=-1)
            assert right[first] == min([j for j in range(i, len(values)) if values[j] < v], default=len(values))
            assert first == min(j for j in range(i + 1) if values[j] == v and j > left[first])


def test_shared_over_any_cut():
    keys = np.array([[1, 0], [1, 1], [1, 0], [1, 1], [2, 2]])
    assert M.shared(np.zeros((3, 3)), np.array([0, 2, 5, 5]), keys).tolist() == [2, 0]
    assert M.shared(np.arange(6).reshape(2, 3), np.array([0, 2, 5]), keys).tolist() == [-1]
