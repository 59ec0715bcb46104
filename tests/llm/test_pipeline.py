"""The pipeline's stages, one after the other, each against brute force on its own input."""

import hashlib

import corpus_pipeline
from convoke.llm import queries

from .test_jaccard_join import brute as near_groups
from .test_windows import brute_bytes, brute_words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.written(stage(spark, docs, SF), "test")
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            after = {r.doc_id: r.text for r in out.collect()}
            assert all(r.n_chars == len(r.text or "") for r in out.collect())
        if name == "toxicity":
            kept_clean = sum(labels[d] == 0 for d in after if d in labels)
            assert kept_clean >= 0.97 * sum(t == 0 for d, t in labels.items() if d in before)
        elif name == "line_dedup":
            for d, text in before.items():
                lines = iter(text.split("\n"))
                assert after[d] == "" or all(any(x == y for y in lines) for x in after[d].split("\n"))
            assert sum(map(len, after.values())) < sum(map(len, before.values()))
        elif name == "ngram_jaccard_join":
            assert sorted(after) == sorted({c for _, _, c in near_groups(list(before.items()))})
        elif name == "suffix_array_dedup":
            want = brute_bytes(list(before.items()), 100)
            for d, text in after.items():
                gone, _, digest = want[d]
                assert gone or hashlib.sha256(text.encode()).hexdigest() == digest
                assert len(before[d].encode()) - gone - 6 * 12 <= len(text.encode()) <= len(before[d].encode()) - gone
        else:
            assert sorted({r.doc_id for r in out.collect()}) == sorted(before)
        docs = out


def test_queries_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    one = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op1_suffix_array_dedup"](spark, SF).collect()}
    assert one == brute_bytes(rows, 100)
    two = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op2_substring_dedup"](spark, SF).collect()}
    assert two == brute_words(rows, 50)
    ten = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op10_ngram_jaccard_join"](spark, SF).collect())
    assert ten == near_groups(rows)


def test_every_query_has_all_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    convs = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    for name, query in queries.QUERIES.items():
        df = query(spark, SF)
        if name.startswith("op13"):
            assert df.where("depth = 0").first().n_convs == convs
        else:
            assert df.select("doc_id").distinct().count() == n, name


def test_near_copies_by_row(spark):
    """A copy goes even where another text under its doc_id stays; a text that repeats under one id stays as often."""
    t, u = ("some words that make a text of their own " * 3, "and others which have nothing to do with these at all " * 3)
    rows = [(3, t), (5, t), (5, u), (7, None), (7, None), (None, "alone with its five words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, df, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [r for r in rows if r != (5, t)]))
