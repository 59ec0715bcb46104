"""Suffix-array dedup: remove bytes covered by a long string that occurs earlier in the corpus.

Method: a run-length index. Stretches of text that may repeat (see ``anchors``) are gathered in lots of a few MB; of
each lot the Burrows-Wheeler transform is built, compressed to its runs, and kept with what the ends of the runs
sample: the text position of each run's first row, the neighbour in suffix order (phi) and the longest common prefix
with it. Between two sampled positions both go on by one a byte, so streaming the text over the samples gives the
matching statistics of every position; matches of at least ``min_bytes`` are marked unless they are the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import keyed, others, table

MIN_BYTES, GRAM = 100, 32
#: Bytes indexed together, about; all of an anchor's contexts always are.
LOT = 1 << 20
U = np.uint64


def packed(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number, each one more than itself; 0 beyond the end of its string."""
    n = len(data)
    wide = np.zeros(n + 8, U)
    wide[:n] = data.astype(U) + U(1)  # UTF-8 has no byte 255
    out = np.zeros(n, U)
    for j in range(8):
        out |= np.where(left > j, wide[j : j + n], U(0)) << U(56 - 8 * j)
    return out


def suffix_order(first: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes; equal suffixes of different strings in the order of place.

    first: a number that orders the first ``depth`` units; left: units to the end of the string."""
    n, longest = len(first), int(left.max(initial=0))
    order = np.argsort(first, kind="stable")
    key = first[order]
    while True:
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if depth >= longest or new.all():
            break
        after = np.zeros(n, np.int64)
        far = np.flatnonzero(left > depth)
        after[far] = rank[far + depth]
        both = (rank << 32) | after
        # Only places whose rank is shared need sorting again, and they stay within the rows of that rank.
        shared = ~(new & np.append(new[1:], True))
        rows = np.flatnonzero(shared)
        at = order[rows]
        order[rows] = at[np.argsort(both[at])]
        key = both[order]
        depth *= 2
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    at = order[tied]
    order[tied] = at[np.argsort((rank[at] << 32) | at)]
    return order


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of some strings, sampled where runs begin.

    heads: text positions of the first rows of all runs, ascending; phi: the position one row above (itself at the
    top); lcp: how many bytes both have in common within their strings."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        n = len(data)
        left = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(n)
        eight = packed(data, left)
        order = suffix_order(eight, left, 8)
        begins = np.zeros(n, bool)
        begins[np.concatenate(([0], ends[:-1]))[np.diff(np.concatenate(([0], ends))) > 0]] = True
        bwt = data[order - 1]
        head = np.ones(n, bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | begins[order[1:]] | begins[order[:-1]]
        rows = np.flatnonzero(head)
        at = order[rows]
        above = np.where(rows > 0, order[rows - 1], at)
        common = self._common(eight, left, at, above)
        common[rows == 0] = 0
        by = np.argsort(at)
        self.heads, self.phi, self.lcp, self.n = at[by], above[by], common[by], n

    @staticmethod
    def _common(eight: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        most = np.minimum(left[p], left[q])
        live = np.flatnonzero(most > 0)
        step = 0
        while len(live):
            x = eight[p[live] + step] ^ eight[q[live] + step]
            same = x == 0
            part = np.full(len(live), 8)
            odd = np.flatnonzero(~same)
            part[odd] = (x[odd, None] < (U(1) << U(8) * np.arange(7, 0, -1).astype(U))).sum(1)
            out[live] = step + part
            step += 8
            live = live[same & (most[live] > step)]
        return np.minimum(out, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position, streamed in text order: its neighbour above in suffix order and the match's length."""
        at = np.zeros(self.n, np.int64)
        at[self.heads] = 1
        at = np.cumsum(at) - 1
        gone = np.arange(self.n) - self.heads[at]
        return self.phi[at] + gone, self.lcp[at] - gone


def earlier(data: np.ndarray, ends: np.ndarray, docs: np.ndarray, win: int) -> np.ndarray:
    """Which windows of win bytes also start at an earlier position of the strings, which come in order of place."""
    if not len(data):
        return np.zeros(0, bool)
    above, match = RunIndex(data, ends).statistics()
    here = np.arange(len(data))
    root = np.where(match >= win, above, here)
    while True:  # to the top row of all that share the window
        further = root[root]
        if (further == root).all():
            break
        root = further
    first = np.empty(len(data), np.int64)
    first[root[::-1]] = here[::-1]
    return here > first[root]


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, heavy: int = anchors.HEAVY) -> DataFrame:
    """(doc, rid, s, e): byte spans of the texts in docs (doc, rid, text) covered by strings that start earlier."""
    return anchors.repeats(docs, anchors.byte_units, min_bytes, gram, earlier, True, LOT, heavy)


def spans_of(column: pa.Array, i: int, offsets: np.ndarray, flat: pa.StructArray) -> list[tuple[int, int]]:
    """The spans of row i, sorted and joined."""
    lo, hi = offsets[i], offsets[i + 1]
    s, e = np.asarray(flat.field("s")[lo:hi]), np.asarray(flat.field("e")[lo:hi])
    _, s, e = anchors.merged(np.zeros(len(s), np.int64), s, e)
    return list(zip(s.tolist(), e.tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        offsets, flat = np.asarray(spans.offsets), spans.values
        none = np.asarray(spans.is_null())
        data, ends = anchors.buffers(batch.column("text"))
        view, begin, kept, removed, count = memoryview(data), 0, [], [], []
        for i, end in enumerate(ends.tolist()):
            found = [] if none[i] else spans_of(spans, i, offsets, flat)
            at, parts = begin, []
            for s, e in found:
                parts.append(view[at : begin + s])
                at = begin + e
            parts.append(view[at:end])
            kept.append(b"".join(parts))
            removed.append(sum(e - s for s, e in found))
            count.append(len(found))
            begin = end
        rest = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] not in ("text", "spans")]
        names = [k for k in batch.schema.names if k not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=[*names, "kept", "n_removed", "n_spans"])


def dedup(documents: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, heavy: int = anchors.HEAVY) -> DataFrame:
    """documents without the bytes that repeat earlier ones: all columns but text, and kept (binary), n_removed, n_spans.

    Earlier means a smaller doc_id, or an earlier start in one document. A null text is empty, a null doc_id comes
    before all others. Texts of fewer than min_bytes bytes stay as they are. Rows that repeat a doc_id are told apart
    by their texts: different ones are ordered by a hash of the text, equal ones are one document and get equal
    results. Other columns pass through unless named as one of the new ones, which then replaces it; an empty table gives
    an empty one."""
    docs = keyed(documents)
    spans = repeated_spans(docs, min_bytes, gram, heavy).groupBy("doc", "rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    held, back = others(documents, "kept", "n_removed", "n_spans")
    whole = keyed(documents, held)
    joined = whole.join(spans, ["doc", "rid"], "left").select("others", "text", "spans")
    schema = f"others {joined.schema['others'].dataType.simpleString()}, kept binary, n_removed long, n_spans long"
    return joined.mapInArrow(_cut, schema).select(*back, "kept", "n_removed", "n_spans")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and spans removed, and the digest of the rest."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", (F.length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
