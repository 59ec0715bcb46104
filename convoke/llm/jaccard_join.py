"""N-gram Jaccard join: which documents share at least three quarters of their five-word shingles?

Equal sets are one entry, known by a hash. Candidates come from prefixes: of two sets that link, each has at least
three quarters of its shingles in common with the other, so under one order of all shingles the first quarter (and one)
of both share a shingle, and more the closer they are in size. The order puts rare shingles first, by counts over all
documents, so what many documents repeat brings hardly any together. Documents of similar size that share as many
prefix shingles as their sizes demand form blocks; within a block every document is looked up by T-occurrence search
(DivideSkip): the short inverted lists of its shingles are heap-merged, the T - 1 longest are only probed, by
bisection, for documents that the merge has found, and those
with the required overlap link. Blocks too large for a task are dealt out as pairs of parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .anchors import U, mix
from .common import NULL_ID, held, keyed, table, written
from .components import components

WORDS = 5
#: Text whose shingles are counted or listed together in a task, and that makes up a bucket of shingles, in bytes.
BLOCK, SHARE = 24 << 20, 16 << 20
#: Shingles known to be frequent in all tasks: 4 bytes each, so a broadcast is 4 MB at most.
KNOWN = 1 << 20
#: Rows of candidates, of some 60 bytes, that are broadcast; more are joined by a shuffle of the texts.
BROADCAST = 1_000_000
#: Shingles of a block that one task may hold.
MOST = 1_500_000
#: Sets with one rare shingle that meet pair by pair; of more, each meets the first of its size.
FEW = 64


def shingles(batch: pa.RecordBatch, words: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each text as sorted 64-bit hashes."""
    data, ends = anchors.buffers(batch.column("text"))
    for _, own, to in anchors.pieces(data, ends):
        lower = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)
        hashes, upto = anchors.word_units(lower, to)
        n = len(hashes)
        gram = hashes.copy()
        for k in range(1, words):
            gram[: max(n - k, 0)] = gram[: max(n - k, 0)] * anchors.power(1) + hashes[k:]
        gram = mix(gram)
        begin = 0
        for end in upto.tolist():
            count = end - begin
            if count >= words:
                yield np.unique(gram[begin : end - words + 1])
            elif count:
                h = U(count)
                with np.errstate(over="ignore"):
                    for x in hashes[begin:end]:
                        h = mix(np.array([h * anchors.power(3) + x]))[0]
                yield np.array([h], U)
            else:
                yield np.zeros(0, U)
            begin = end


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a set, signed."""
    with np.errstate(over="ignore"):
        return int((mix(s ^ U(0x5555)).sum(dtype=U) * U(31) + mix(s).sum(dtype=U) ^ U(len(s))).astype(np.int64)) if len(s) else 0


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("shingles")
    for batch in batches:
        sets = list(shingles(batch))
        n, sid = [len(s) for s in sets], [set_id(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(sid, pa.int64())], names=["doc", "rid", "n", "sid"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The different sets of about BLOCK bytes of text each."""
    held("shingles")
    sets: dict[int, np.ndarray] = {}
    size = 0
    for batch in batches:
        size += batch.column("text").nbytes
        for s in shingles(batch):
            if len(s):
                sets.setdefault(set_id(s), s)
        if size >= BLOCK:
            yield sets
            sets, size = {}, 0
    if sets:
        yield sets


def short(s: np.ndarray) -> np.ndarray:
    """32 bits of shingles' hashes, by which they are counted (two that coincide only count as more frequent)."""
    return (s >> U(32)).astype(np.uint32)


def _by_bucket(buckets: int, token: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    which = token % token.dtype.type(buckets)
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(buckets + 1))
    for k in range(buckets):
        part = order[edges[k] : edges[k + 1]]
        if len(part):
            yield k, *(x[part].tobytes() for x in (token, *more))


def _counted(buckets: int):
    """Shingles of each block with their counts, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _blocks(batches):
            token, n = np.unique(np.concatenate([short(s) for s in sets.values()]), return_counts=True)
            once = n == 1
            one = {k: x for k, x in _by_bucket(buckets, token[once])}
            more = {k: (x, y) for k, x, y in _by_bucket(buckets, token[~once], n[~once].astype(np.uint32))}
            for k in one.keys() | more.keys():
                x, y = more.get(k, (b"", b""))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([one.get(k, b"")]), pa.array([x]), pa.array([y])], names=["bucket", "once", "token", "n"])

    return run


def _frequent(group: pa.Table) -> pa.Table:
    """Of a bucket, the shingles in 16 documents or more, by the power of two of their number."""
    once = np.frombuffer(b"".join(group.column("once").to_pylist()), np.uint32)
    token = np.concatenate((once, np.frombuffer(b"".join(group.column("token").to_pylist()), np.uint32)))
    n = np.concatenate((np.ones(len(once), np.int64), np.frombuffer(b"".join(group.column("n").to_pylist()), np.uint32).astype(np.int64)))
    order = np.argsort(token)
    token, n = token[order], n[order]
    edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    token, n = token[edges], np.add.reduceat(n, edges)
    level = np.floor(np.log2(n)).astype(np.int32)
    levels = [k for k in range(4, 64) if (level == k).any()]
    return pa.table({"level": pa.array(levels, pa.int32()), "tokens": pa.array([token[level == k].tobytes() for k in levels], pa.binary())})


def known_frequent(docs: DataFrame, buckets: int, known: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and the power of two of their number of documents; ``known`` at most.

    All shingles of all documents are counted; whole powers of two are left out from below until the rest fits."""
    rows = docs.mapInArrow(_counted(buckets), "bucket int, once binary, token binary, n binary")
    found = written(rows.groupBy("bucket").applyInArrow(_frequent, "level int, tokens binary"), "frequent")
    sizes = dict(found.groupBy("level").agg((F.sum(F.length("tokens")) / 4).cast("long")).collect())
    least, total = 64, 0
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > known:
            break
        least = level
    blobs = found.where(F.col("level") >= least).collect()
    token = np.concatenate([np.frombuffer(r.tokens, np.uint32) for r in blobs] or [np.zeros(0, np.uint32)])
    level = np.concatenate([np.full(len(r.tokens) // 4, r.level, np.int8) for r in blobs] or [np.zeros(0, np.int8)])
    order = np.argsort(token)
    return token[order], level[order]


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n has in common with every set it links with, at least."""
    return -(-3 * n // 4)


def prefix(s: np.ndarray, token: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shortest start of a set, rare shingles first, that shares one with the start of every set it links with; and
    which of them are known to be frequent."""
    length = len(s) - int(needed(len(s))) + 1
    t = short(s)
    if len(token):
        at = np.minimum(np.searchsorted(token, t), len(token) - 1)
        lv = np.where(token[at] == t, level[at], 0)
        if lv.any():
            first = np.argsort(lv, kind="stable")[:length]
            return s[first], lv[first] > 0
    return s[:length], np.zeros(length, bool)


def starred(token: np.ndarray, n: np.ndarray, sid: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (token, size class, sid), and the first row of each run with one token whose classes step by ``near``
    at most: sets that link are in the same class or in neighbouring ones."""
    q = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.int64)
    order = np.lexsort((sid, q, token))
    token, q = token[order], q[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (q[1:] - q[:-1] > near)
    if near == 0:
        new[1:] |= q[1:] != q[:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of different numbers."""
    at = np.flatnonzero(a != b)
    both = np.unique(np.stack((a[at], b[at])), axis=1)
    return both[0], both[1]


POSTED = "bucket int, token binary, n binary, sid binary, rare_token binary, rare_n binary, rare_sid binary, a binary, b binary"


def _posted(buckets: int, frequent):
    """Prefix shingles of each block. Of the sets with one frequent shingle and one size class one stays for it, the
    others are edges to that one; rare shingles keep all their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = frequent.value
        for sets in _blocks(batches):
            starts = [prefix(s, known, level) for s in sets.values()]
            count = [len(x) for x, _ in starts]
            token, often = (np.concatenate(x) for x in zip(*starts, strict=True))
            sid = np.repeat(np.array(list(sets), np.int64), count)
            n = np.repeat(np.array([len(s) for s in sets.values()], np.uint32), count)
            rare = {k: x for k, *x in _by_bucket(buckets, token[~often], n[~often], sid[~often])}
            token, n, sid = token[often], n[often], sid[often]
            order, first = starred(token, n, sid, 0)
            token, n, sid = token[order], n[order], sid[order]
            a, b = pairs(sid, sid[first])
            lead = np.unique(first)
            often = {k: x for k, *x in _by_bucket(buckets, token[lead], n[lead], sid[lead])}
            none = [b""] * 3
            rows = [(k, *often.get(k, none), *rare.get(k, none), b"", b"") for k in often.keys() | rare.keys()]
            rows += [(i // 5000 % buckets, *none, *none, a[i : i + 5000].tobytes(), b[i : i + 5000].tobytes()) for i in range(0, len(a), 5000)]
            if rows:
                cols = list(zip(*rows, strict=True))
                names = ["bucket", "token", "n", "sid", "rare_token", "rare_n", "rare_sid", "a", "b"]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

    return run


def _met(group: pa.Table, few: int = FEW) -> pa.Table:
    """Of a bucket: edges between sets with a frequent prefix shingle in common, a star for each; and pairs of sets that
    share rare ones, with how many they share here and how many they need in all.

    Of two sets the one whose prefix ends first has its other shared shingles behind it, so they must share in their
    prefixes what the required overlap has beyond the longer of the rests."""
    read = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    rare_token, rare_n, rare_sid = read("rare_token", U), read("rare_n", np.uint32), read("rare_sid", np.int64)
    order = np.lexsort((rare_sid, rare_token))
    rare_token, rare_n, rare_sid = rare_token[order], rare_n[order], rare_sid[order]
    new = np.ones(len(rare_token), bool)
    new[1:] = (rare_token[1:] != rare_token[:-1]) | (rare_sid[1:] != rare_sid[:-1])  # one set may come from several blocks
    rare_token, rare_n, rare_sid = rare_token[new], rare_n[new], rare_sid[new]
    # What more than FEW sets have is frequent after all: stars in place of all pairs.
    edges = np.flatnonzero(np.concatenate((rare_token[1:] != rare_token[:-1], [True]))) if len(rare_token) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate(([-1], edges)))
    many = np.repeat(times > few, times)
    token, n, sid = (np.concatenate((x, y[many])) for x, y in ((read("token", U), rare_token), (read("n", np.uint32), rare_n), (read("sid", np.int64), rare_sid)))
    order, first = starred(token, n, sid, 1)
    sid = sid[order]
    a, b = pairs(np.concatenate((sid, read("a", np.int64))), np.concatenate((sid[first], read("b", np.int64))))
    token, n, sid = rare_token[~many], rare_n[~many].astype(np.int64), rare_sid[~many]
    left, right, apart = [], [], 1
    while apart < len(token):
        at = np.flatnonzero(token[apart:] == token[:-apart])
        if not len(at):
            break
        x, y = n[at], n[at + apart]
        at = at[4 * np.minimum(x, y) >= 3 * np.maximum(x, y)]
        left.append(at)
        right.append(at + apart)
        apart += 1
    i, j = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (left, right))
    order = np.lexsort((sid[j], sid[i]))
    i, j = i[order], j[order]
    edge = np.flatnonzero(np.concatenate(([True], (sid[i][1:] != sid[i][:-1]) | (sid[j][1:] != sid[j][:-1])))) if len(i) else np.zeros(0, np.int64)
    times = np.diff(np.append(edge, len(i)))
    i, j = i[edge], j[edge]
    need = -(-3 * (n[i] + n[j]) // 7) - np.maximum(needed(n[i]), needed(n[j])) + 1
    zero = np.zeros(len(a), np.int64)
    return pa.table({"a": np.concatenate((a, sid[i])), "b": np.concatenate((b, sid[j])), "c": np.concatenate((zero, times)), "need": np.concatenate((zero, need))})


def overlap(n: int, m: int) -> int:
    """Shingles that sets of these sizes must share to link."""
    return -(-3 * (n + m) // 7)


class TOccurrence:
    """Inverted lists of some sets, searched with DivideSkip."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.size: dict[int, int] = {}

    def add(self, i: int, tokens: list[int]) -> None:
        """Numbers must come in ascending order."""
        self.size[i] = len(tokens)
        for t in tokens:
            self.lists.setdefault(t, []).append(i)

    def search(self, tokens: list[int], skip=lambda i: False) -> Iterator[int]:
        """Sets that link with these shingles."""
        n = len(tokens)
        least = overlap(n, -(-3 * n // 4))
        found = [x for x in map(self.lists.get, tokens) if x]
        if len(found) < least:
            return
        found.sort(key=len)
        cut = len(found) - (least - 1)
        probed = found[cut:]
        for i, hits in groupby(merge(*found[:cut])):
            if skip(i):
                continue
            need = overlap(n, self.size[i])
            count, left = sum(1 for _ in hits), len(probed)
            for x in probed:
                if count >= need or count + left < need:
                    break
                left -= 1
                at = bisect_left(x, i)
                count += at < len(x) and x[at] == i
            if count >= need:
                yield i


def linked(sets: list[list[int]]) -> list[int]:
    """For each set, the first of those it is connected with by links.

    First each set is looked up among those that linked with none before (leaders). Links between different groups
    that this leaves are then found by looking up every set outside the largest group among all others."""
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(i: int, j: int) -> None:
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)

    leaders = TOccurrence()
    for i, s in enumerate(sets):
        near = list(leaders.search(s))
        for j in near:
            join(i, j)
        if not near:
            leaders.add(i, s)
    groups = Counter(map(top, range(len(sets))))
    if len(groups) > 1 and len(leaders.size) < len(sets):
        every = TOccurrence()
        for i, s in enumerate(sets):
            every.add(i, s)
        largest = groups.most_common(1)[0][0]
        for i in [i for i in range(len(sets)) if top(i) != largest]:
            for j in every.search(sets[i], lambda j, i=i: top(j) == top(i)):
                join(i, j)
    return [top(i) for i in range(len(sets))]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each in rows that follow one another, as edges from each set to the first of its group."""
    held, last = {}, None

    def flush() -> pa.RecordBatch:
        ids = sorted(held, key=lambda i: (len(held[i]), i))
        roots = linked([_unpacked(held[i]) for i in ids])
        return pa.RecordBatch.from_arrays([pa.array([last[0]] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array([ids[r] for r in roots], pa.int64())], names=["block", "a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in ("block", "i", "j")), strict=True)
        for key, sid, tokens in zip(keys, batch.column("sid").to_pylist(), batch.column("tokens"), strict=True):
            if key != last and held:
                yield flush()
                held = {}
            last = key
            held[sid] = tokens.as_py()
    if held:
        yield flush()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """48 bits of each shingle's hash, for each pair of parts that the set's part is in."""
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in ("sid", "block", "parts", "part")), strict=True)
        rows, size = [], 0
        for (sid, block, parts, part), s in zip(keys, shingles(batch), strict=True):
            data = (s >> U(32)).astype(np.uint32).tobytes() + (s >> U(16)).astype(np.uint16).tobytes()
            rows += [(sid, block, min(part, o), max(part, o), data) for o in range(int(parts))]
            size += len(data) * int(parts)
            if size >= 1 << 22:
                yield _dealt(rows)
                rows, size = [], 0
        if rows:
            yield _dealt(rows)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ["sid", "block", "i", "j", "tokens"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _unpacked(data: bytes) -> list[int]:
    n = len(data) // 6
    return (np.frombuffer(data, np.uint32, n).astype(np.int64) << 16 | np.frombuffer(data, np.uint16, n, 4 * n)).tolist()


def linked_sets(docs: DataFrame, described: DataFrame, known: int = KNOWN, most: int = MOST) -> DataFrame:
    """(sid, root): for the sets that may link with others, the group they belong to. docs: doc, rid, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // SHARE))
    frequent = docs.sparkSession.sparkContext.broadcast(known_frequent(docs.select("text"), buckets, known))
    rows = docs.select("text").mapInArrow(_posted(buckets, frequent), POSTED)
    met = rows.groupBy("bucket").applyInArrow(lambda group: _met(group), "a long, b long, c long, need long")
    met = met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need"))
    edges = written(met.where("c >= need").select("a", "b"), "candidates")
    blocks = components(edges, "blocks").select(F.col("node").alias("sid"), F.col("component").alias("block"))
    sets = described.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc", "rid")).alias("at"), F.first("n").alias("n"))
    member = written(blocks.join(sets, "sid").select("sid", "block", "n", "at.doc", "at.rid"), "members")
    parts = member.groupBy("block").agg(F.ceil(2 * F.sum("n") / F.lit(most)).alias("parts"))
    # A block within bounds is one part; a larger one is cut, and every two of its parts meet in a task.
    parts = parts.withColumn("parts", F.when(F.col("parts") <= 2, 1).otherwise(F.col("parts")))
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part")
    dealt = member.join(parts, "block").select("doc", "rid", "sid", "block", "parts", part)
    side = F.broadcast(dealt) if member.count() <= BROADCAST else dealt
    sets = docs.join(side, ["doc", "rid"]).select("sid", "block", "parts", "part", "text")
    sets = sets.mapInArrow(_tokens, "sid long, block long, i int, j int, tokens binary")
    whole = sets.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    found = written(whole.mapInArrow(_searched, "block long, a long, b long"), "links")
    cut = found.join(parts.where("parts > 1").select("block"), "block", "left_semi")
    kept = found.join(parts.where("parts > 1").select("block"), "block", "left_anti")
    merged = components(cut.select("a", "b"), "merged").select(F.col("node").alias("sid"), F.col("component").alias("root"))
    return kept.select(F.col("a").alias("sid"), F.col("b").alias("root")).unionByName(merged)


def groups(documents: DataFrame, known: int = KNOWN, most: int = MOST) -> DataFrame:
    """documents with n_shingles and component_id in place of text: the smallest doc_id reachable by links.

    Words are split at white space, A to Z lower-cased; a text of fewer than five words has one shingle, all its
    words. A null or empty text has none and links with nothing. A null doc_id is smaller than all others. Rows that
    repeat a doc_id each have the result of their own text. Other columns pass through unless named as one of the new
    ones, which then replaces it."""
    docs = keyed(documents)
    described = written(docs.mapInArrow(_described, "doc long, rid int, n long, sid long"), "sets")
    roots = linked_sets(docs, described, known, most)
    rooted = described.where("n > 0").join(roots, "sid", "left").select("doc", "rid", "n", F.coalesce("root", "sid").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    named = rooted.join(least, "root").select("doc", "rid", "n", "component")
    named = named.unionByName(described.where("n = 0").select("doc", "rid", "n", F.col("doc").alias("component"))).groupBy("doc", "rid").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    new = ["n_shingles", "component_id"]
    others = [c for c in documents.columns if c != "text" and c.lower() not in new]
    whole = keyed(documents, F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("others")).drop("text")
    out = whole.join(named, ["doc", "rid"]).select("others.*", F.col("n").alias("n_shingles"), F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))
    return out.drop("_")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its shingle set and the smallest doc_id of its group."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
