"""Toxicity: held-out accuracy, and the parts of the model."""

import random
import zlib

import numpy as np
import pyarrow as pa

from convoke.llm import toxicity as T


def test_isotonic():
    x, y = T.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and 0.5 in y


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3) | (x[:, 1] > 0.9)).astype(float)
    trees = T.Trees().fit(x[:3000], y[:3000])
    assert ((trees.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_features_see_obfuscation():
    lexicon = T.Lexicon({"idiot": 5.0, "scum": 4.0})
    x = T.features(pa.array(["you 1d1ot!", "YOU ARE SCUM", "a clean text", "", "id-iot idiooooot"]), lexicon)
    col = {k: x[:, i] for i, k in enumerate(T.FEATURES)}
    assert (col["log_hits"] > 0).tolist() == [True, True, False, False, True]
    assert (col["hidden_hits"] > 0).tolist() == [True, False, False, False, True] and (col["near_second"] > 0).tolist() == [True, True, False, False, False]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = T.scored(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["bad" * (i % 2), *(rng.choice("abcdef") * 3 for _ in range(9))]), i) for i in range(80)] + [(None, None, 1), (500, "", 2), (500, "", 2), (501, "x " * 60_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, None)], "doc_id long, toxic int")
    assert len(T.scored(df, labels).collect()) == 84
    assert {r.score for r in T.scored(df, labels.limit(0)).collect()} == {0.0}
    assert T.scored(df.limit(0), labels).count() == 0
