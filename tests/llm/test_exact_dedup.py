"""Exact dedup and its index against brute force."""

import hashlib
import random
import re

from convoke.llm.exact_dedup import CuckooIndex, groups


def test_index_keeps_what_is_live():
    rng = random.Random(3)
    index, live = CuckooIndex(2), {}
    for step in range(6000):
        digest = hashlib.sha256(str(rng.randrange(2500)).encode()).digest()
        if rng.random() < 0.35:
            assert index.delete(digest) == live.pop(digest, None)
        elif digest not in live:
            assert index.find(digest) is None
            index.insert(digest, (step,))
            live[digest] = (step,)
        if step % 500 == 0:
            assert all(index.maybe(d) and index.find(d)[1] == v for d, v in live.items())
    assert dict(index.items()) == live and index.count == len(live) and index.mask > 100


def test_groups(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", " ", "a b", "ab", "a  b", "é c", "éc ", "x" * rng.randrange(40)]), i % 3) for i in range(300)]
    rows += [(7, "ab", 1), (None, "ab", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(4)
    by = {}
    for doc, text, _ in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is not None, doc or 0, doc))
    want = sorted(str((doc, min(by[k])[3], len(by[k]), hashlib.sha256(k.encode()).hexdigest())) for doc, text, _ in rows for k in [re.sub(r"[\x20\x09-\x0D]", "", text or "")])
    got = groups(df).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})
    # Rows that repeat, and rows of the kept doc_id with a shorter text: one row a group stays.
    again = spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "a b"), (2, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in groups(again).collect()) == [(1, 1, False)] * 3 + [(1, 1, True), (2, 1, False)]
    assert groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
