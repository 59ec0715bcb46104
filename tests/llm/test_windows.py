"""Suffix-array dedup and substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from convoke.llm import suffix_array, suffix_tree


def brute_bytes(rows, win):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - win + 1):
            w = b[i : i + win]
            if w in seen:
                gone[i : i + win] = b"\1" * win
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[doc] = (sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, win):
    first, words = {}, {}
    for doc, text in rows:
        w = words[doc] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(w) - win + 1):
            k = tuple(w[i : i + win])
            first[k] = min(first.get(k, doc), doc)
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - win + 1):
            if first[tuple(w[i : i + win])] < doc:
                gone[i : i + win] = [True] * win
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [rng.choice(["ab", "é", "xyz", "lorem", "q", "ß"]) + str(rng.randrange(40)) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [say(rng.randrange(20, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(3):
                w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        elif kind == 2:
            text = rng.choice([None, "", "a" * 260, "ab " * 150, " \t\n"])
        else:
            text = say(rng.randrange(1, 120)) + "\n" + rng.choice(shared) + "\t" + say(rng.randrange(1, 60)) + rng.choice(["", " " + rng.choice(shared)])
        rows.append((i * 3, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,heavy", [(1, 12_000), (2, 3), (3, 1)])
def test_bytes(spark, seed, heavy):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_array.dedup(df, 100, 32, heavy).collect()}
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("seed,heavy", [(4, 12_000), (5, 3), (6, 1)])
def test_words(spark, seed, heavy):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in suffix_tree.dedup(df, 50, 8, heavy).collect()}
    assert got == brute_words(rows, 50)


def test_odd_rows(spark):
    long = "word " * 40_000
    rows = [(None, "x" * 150, 1), (1, "x" * 150, 2), (1, "x" * 150, 2), (2, None, None), (2, "", 3), (3, long, 4), (4, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = suffix_array.dedup(df.withColumnRenamed("kept", "spans")).collect()
    by = {(r.doc_id, r.spans): r for r in out}
    assert len(out) == 7 and by[None, 1].n_removed == 149
    assert by[1, 2].n_removed == 150 and by[4, 5].n_removed == len(long)
    assert by[2, None].n_removed == 0 and by[2, 3].n_removed == 0
    words = {(r.doc_id, r.spans): r for r in suffix_tree.dedup(df.withColumnRenamed("kept", "spans")).collect()}
    assert words[4, 5].n_removed == 40_000 and words[3, 4].n_removed == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.dedup(empty).count() == 0 and suffix_tree.dedup(empty).count() == 0
