"""Covering SimHash against all pairs."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from convoke.llm import covering_simhash as M


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parts(prints):
    """Each print's smallest one among those that links of all pairs connect."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 4:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {p: find(p) for p in root}


def near(rng, base, most):
    return base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(most + 1)))


def test_every_pair_meets():
    rng = random.Random(1)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
        tables = [v for v, m in enumerate(M.TABLES) if not (a ^ b) & m]
        assert tables
        assert any(not (a ^ b) & m for m in M.parting(M.TABLES[tables[0]]))
    assert min(m.bit_count() for m in M.TABLES) == 32
    assert min(m.bit_count() for t in M.TABLES for m in M.parting(t)) == 48


@pytest.mark.parametrize("large", [2, 40, M.LARGE])
def test_links_connect_what_all_pairs_connect(spark, large):
    rng = random.Random(large)
    prints = {0} | {near(rng, c, 9) for c in [rng.getrandbits(64) for _ in range(6)] for _ in range(60)} | {near(rng, 2**64 - 1, 3) for _ in range(80)}
    df = spark.createDataFrame([(M.signed(p),) for p in prints], "print long").repartition(3)
    links = [(a % 2**64, b % 2**64) for a, b in M.linked(df, large=large).select("a", "b").collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links) and len(links) == len(set(links)) < 31 * len(prints)
    want, root = parts(prints), {p: p for p in prints}
    for _ in range(len(prints)):
        changed = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
        if not changed:
            break
    assert root == want


def test_groups_over_batches():
    rng = np.random.default_rng(4)
    prints = np.sort(rng.integers(0, 2**12, 400).astype(np.uint64))
    prints = np.unique(prints)
    key = (prints >> np.uint64(9)).astype(np.int64)
    table = pa.table({"v": pa.array(np.zeros(len(key), np.int32)), "u": pa.array(np.zeros(len(key), np.int32)), "key": key, "print": prints.view(np.int64)})
    whole = [r for b in M.linker(4, None)(iter(table.to_batches())) for r in b.to_pylist()]
    for size in (1, 3, 50):
        assert [r for b in M.linker(4, None)(iter(table.to_batches(size))) for r in b.to_pylist()] == whole
        hot = [r for b in M.linker(4, 20)(iter(table.to_batches(size))) for r in b.to_pylist()]
        counts = np.bincount(key)
        assert sorted(r["a"] for r in hot if r["b"] is None) == [int(p) for p, k in zip(prints, key, strict=True) if counts[k] > 20]


def test_texts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(n)] for n in (400, 90, 30)]
    texts = [None, "", " \t", "One", "one", "one two three", "One  two\x0bthree", "é É", "a b c d", "x " * 50_000 + "y"]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(rng.randrange(3)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c).title())
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (40, "other"), (40, "other"), (40, "not the other"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = [plain_print(t) for _, t in rows]
    part, least = parts(set(prints)), {}
    for (d, _), p in zip(rows, prints, strict=True):
        least.setdefault(part[p], []).append((d is not None, d or 0, d))
    want = sorted(repr((d, f"{p:016x}", min(least[part[p]])[2])) for (d, _), p in zip(rows, prints, strict=True))
    assert sorted(repr(tuple(r)) for r in M.groups(df).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert [M.fingerprint((t or "").encode()) for _, t in rows] == [M.signed(p) for p in prints]


def test_spark_hashes_alike(spark):
    for text in ("", "a", "some words and more of them, enough for all of the lanes of the hash"):
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == M.signed(xxhash.xxh64_intdigest(text.encode(), 42))


def test_empty_and_clashing(spark):
    assert M.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = M.groups(spark.createDataFrame([(1, "a b", "old", 4)], "doc_id long, text string, Fingerprint string, print int"))
    assert out.columns == ["doc_id", "print", "fingerprint", "component_id"] and out.first()[:2] == (1, 4) and out.first().component_id == 1
