"""Fill-in-middle against a regular expression, text by text."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoke.llm import fill_in_middle as M

PIECES = ["<P>", "<S", "<M>", "<", ">", "P", "<<P", "a", "Zz", "é", "€", "𝄞", "\n", "\0", " ", "1", "ab<", "<é>", ""]


def plainly(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rng, n, longest):
    return ["".join(rng.choices(PIECES, k=rng.randrange(longest))) for _ in range(n)]


def test_automaton_forgets():
    assert M.DEPTH == 2
    with pytest.raises(ValueError):
        M.memory(np.array([0] * 256 + [1] * 256, np.uint8))


@pytest.mark.parametrize("size", [3, 7, 64])
def test_scan_in_any_slices(monkeypatch, size):
    monkeypatch.setattr(M, "BLOCK", size)
    monkeypatch.setattr(M, "SLICE", size * 2)
    rng = random.Random(size)
    some = [x.encode() for x in texts(rng, 60, 12)]
    scan = M.Scan(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
    for i, x in enumerate(some):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", x.decode())
        assert scan.units[i] == len(units) and (scan.sentinels[i] > 0) == bool(re.search("<[PSM]>", x.decode()))
        k = np.arange(len(units) + 1)
        place, characters = scan.located(np.full(len(k), i), k)
        before = ["".join(units[:j]) for j in k]
        assert (place - scan.offsets[i]).tolist() == [len(y.encode()) for y in before]
        assert characters.tolist() == [len(y) for y in before]


def test_rows(spark):
    rng = random.Random(8)
    some = texts(rng, 300, 30) + [None, "", "x" * 100_000, "é<" * 70_000, "word and " * 30_000]
    rows = [(i * 7 - 50, t) for i, t in enumerate(some)] + [(None, "no id here"), (5, "twice"), (5, "twice"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = M.fill_in_middle(df).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    order = lambda x: sorted(x, key=repr)
    assert order(tuple(r) for r in out) == order((d, *plainly(d, t), t or "") for d, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_empty_and_clashing(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b", "old", "x", 4)], "doc_id long, text string, FORM string, data string, draws int")
    out = M.fill_in_middle(df)
    assert out.columns == ["doc_id", "data", "draws", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.first()[:5] == (1, "x", 4, *plainly(1, "a b")[:2])
