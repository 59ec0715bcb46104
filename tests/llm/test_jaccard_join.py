"""N-gram Jaccard join and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from convoke.llm import jaccard_join
from convoke.llm.components import components
from convoke.llm.jaccard_join import groups, linked


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=220):
    rng = random.Random(seed)
    say = lambda k: [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(k)]
    line, rows = say(30), []
    for i in range(n):
        kind = rng.randrange(6)
        if kind <= 2 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "X" + str(rng.randrange(99))
            text = " ".join(w)
        elif kind == 3:
            text = rng.choice([None, "", "  ", "one", "One two", "one two", " ".join(line)])
        else:
            text = " ".join(say(rng.randrange(3, 60)) + (line if rng.random() < 0.5 else []) + say(rng.randrange(20)))
        rows.append((i * 2 + 1, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,known,most", [(1, 1 << 20, 4_000_000), (2, 0, 4_000_000), (3, 5, 300)])
def test_groups(spark, seed, known, most):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in groups(df, known, most).collect())
    assert got == brute(rows)


def test_second_phase():
    a = list(range(40))
    b, c = a[4:] + [100, 101, 102, 103], a[8:] + [100, 101, 102, 103, 110, 111, 112, 113]
    assert linked([a, c, b]) == [0, 0, 0] and linked([a, b, c, [1, 2]]) == [0, 0, 0, 3]


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 2), (6, None, 3), (None, None, 4), (7, "w " * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in groups(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, None), (5, 2, None), (6, 0, 6), (None, 0, None), (7, 1, 7)], key=str)
    assert groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four"])
def test_one_short_text(spark, text):
    """A lot of pieces that holds fewer words than a shingle."""
    got = groups(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(3, 1, 3)]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    root = {}
    for x, y in edges:
        root.setdefault(x, x), root.setdefault(y, y)
    for _ in range(400):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_stars_for_shared_rare_shingles():
    """A bucket whose shingles many sets share gives the same groups with stars as pair by pair."""
    rng = np.random.default_rng(8)
    token = rng.integers(0, 40, 3000).astype(np.uint64)
    n = rng.integers(20, 60, 3000).astype(np.uint32)
    sid = (np.arange(3000) % 400 + 1).astype(np.int64)
    n = n[sid - 1]
    none = pa.array([b""])
    cols = {k: none for k in ("token", "n", "sid", "a", "b")} | {"rare_token": pa.array([token.tobytes()]), "rare_n": pa.array([n.tobytes()]), "rare_sid": pa.array([sid.tobytes()])}
    group = pa.table({"bucket": pa.array([0], pa.int32()), **cols})

    def roots(few):
        out, root = jaccard_join._met(group, few).to_pydict(), {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b, c, need in zip(*(out[k] for k in ("a", "b", "c", "need")), strict=True):
            if c >= need:
                x, y = sorted((top(a), top(b)))
                root[y] = x
        return out, top

    every, _ = roots(10**6)
    stars, top = roots(4)
    assert len(stars["a"]) < len(every["a"]) / 4
    assert all(top(a) == top(b) for a, b, c, need in zip(*(every[k] for k in ("a", "b", "c", "need")), strict=True) if c >= need)
