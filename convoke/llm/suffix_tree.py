"""Substring dedup: remove words covered by a long run of words that also starts in an earlier document.

Method: prefix-partitioned suffix trees. Suffixes that may repeat for ``window`` words are partitioned by a prefix of
them, the anchor gram that they share (see ``anchors``); where that prefix has too many suffixes it is lengthened to
the whole window, so every group fits in memory. Of each group the suffix tree is built from its sorted suffixes and
their common prefixes; the occurrences of a maximal repeat are the leaves below an internal node of ``window`` words
or deeper, and all of them but those of the first document are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import keyed, others, table
from .suffix_array import spans_of, suffix_order

WINDOW, GRAM = 50, 8
#: Words in the trees that are built together, about.
LOT = 1 << 18
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class SuffixTree:
    """The suffix tree of some word strings as its leaves in order and the depth of the branching before each.

    An internal node is a stretch of leaves between two branchings that are less deep than all inside it."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.left = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(n)
        self.ids = np.unique(words, return_inverse=True)[1].reshape(-1)
        self.leaves = suffix_order(self.ids, self.left, 1)
        self.depth = np.zeros(n, np.int64)
        p, q = self.leaves[1:], self.leaves[:-1]
        most = np.minimum(self.left[p], self.left[q])
        live = np.flatnonzero(most > 0)
        for k in range(int(most.max(initial=0))):
            live = live[most[live] > k]
            live = live[self.ids[p[live] + k] == self.ids[q[live] + k]]
            self.depth[live + 1] = k + 1

    def deep_nodes(self, least: int) -> np.ndarray:
        """For each leaf in order, the number of the topmost internal node of that depth above it, or its own."""
        return np.cumsum(self.depth < least) - 1


def earlier(words: np.ndarray, ends: np.ndarray, docs: np.ndarray, win: int) -> np.ndarray:
    """Which windows of win words also start in a string of a smaller document."""
    if not len(words):
        return np.zeros(0, bool)
    tree = SuffixTree(words, ends)
    doc = np.repeat(docs, np.diff(np.concatenate(([0], ends))))[tree.leaves]
    node = tree.deep_nodes(win)
    edges = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    first = np.minimum.reduceat(doc, edges)[node]
    out = np.zeros(len(words), bool)
    out[tree.leaves] = (doc > first) & (tree.left[tree.leaves] >= win)
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = anchors.HEAVY) -> DataFrame:
    """(doc, rid, s, e): word spans of the texts in docs (doc, rid, text) covered by windows of earlier documents."""
    return anchors.repeats(docs, anchors.word_units, window, gram, earlier, False, LOT, heavy)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        offsets, flat, none = np.asarray(spans.offsets), spans.values, np.asarray(spans.is_null())
        kept, count, removed = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = WORD.findall(text)
            count.append(len(words))
            if not none[i]:
                at, parts = 0, []
                for s, e in spans_of(spans, i, offsets, flat):
                    parts += words[at:s]
                    at = e
                words = parts + words[at:]
            removed.append(count[-1] - len(words))
            kept.append(" ".join(words))
        rest = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] not in ("text", "spans")]
        names = [k for k in batch.schema.names if k not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "kept", "n_words", "n_removed"])


def dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = anchors.HEAVY) -> DataFrame:
    """documents without the words that repeat earlier ones: all columns but text, and kept (words joined by one
    space), n_words, n_removed.

    Earlier means a smaller doc_id; a null doc_id comes before all others and a null text has no words. Rows that
    repeat a doc_id never remove words from each other. Other columns pass through unless named as one of the
    new ones, which then replaces it; an empty table gives an empty one."""
    docs = keyed(documents)
    spans = repeated_spans(docs, window, gram, heavy).groupBy("doc", "rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    held, back = others(documents, "kept", "n_words", "n_removed")
    whole = keyed(documents, held)
    joined = whole.join(spans, ["doc", "rid"], "left").select("others", "text", "spans")
    schema = f"others {joined.schema['others'].dataType.simpleString()}, kept string, n_words long, n_removed long"
    return joined.mapInArrow(_cut, schema).select(*back, "kept", "n_words", "n_removed")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words removed, and the digest of the rest."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
