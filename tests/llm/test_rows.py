"""Columns that are named as an operator's new ones: replaced, once, and nothing else changed."""

import pytest

from convoke.llm import exact_dedup, jaccard_join, line_dedup, media, packing, sentence_pieces, suffix_array, suffix_tree, token_counts

NEW = {
    suffix_array.dedup: ("kept", "n_removed", "n_spans"),
    suffix_tree.dedup: ("kept", "n_words", "n_removed"),
    packing.pack: ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"),
    token_counts.token_counts: ("n_bytes", "n_tokens", "over_limit", "fit_bytes"),
    sentence_pieces.encoded: ("ids", "decoded"),
    media.text_images: ("n_bytes", "payload_sha256", "feature", "tile_hashes"),
    exact_dedup.groups: ("keep_id", "group_size", "kept", "text_sha256"),
    line_dedup.dedup: ("n_lines", "n_removed"),
    jaccard_join.groups: ("n_shingles", "component_id"),
}


@pytest.mark.parametrize("operator", NEW, ids=lambda f: f"{f.__module__.rsplit('.', 1)[-1]}.{f.__name__}")
def test_clashing_columns(spark, operator):
    names = NEW[operator]
    rows = [(i, text, "mine", *["old"] * len(names)) for i, text in enumerate(["one two three", None, "", "one two three"])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, other string, {', '.join(f'{c} string' for c in names)}")
    out = operator(df)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    got = out.select("doc_id", "other", *names).collect()
    assert {(r.doc_id, r.other) for r in got} == {(i, "mine") for i in range(4)}
    assert all("old" not in r[2:] for r in got)
