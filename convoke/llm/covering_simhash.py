"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its hashed shingles have it. Each of the 64 bit places is given a
non-zero vector of RADIUS + 1 bits, and table v (each non-zero vector again) compares the places whose vectors have an odd
product with v. The places in which two fingerprints differ, RADIUS of them at most, span too little for every v: some v
is orthogonal to them all, so in its table the two are equal. With a radius of 4 that is 31 tables of 33 bits or so, and
no pair within the radius is lost.

Only different fingerprints meet, each with the smallest id it stands for. Those that are equal in a table are joined by a
walk that leaves a spanning forest of their links, not all pairs. A group of over LARGE is dealt out by a second set of
masks instead, which leaves 65,536 different fingerprints in a group at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, dropped, others, table, written
from .components import components

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 4

#: Fingerprints that are equal in a table and still meet in one walk.
LARGE = 4096

#: Of fingerprints with over 1/HOT of the rows each there are fewer than HOT: so many are broadcast.
HOT = 65_536

#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """What each table compares: the vectors 1 ... 2^(radius + 1) - 1 go round over the places."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(places) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]


TABLES = masks(list(range(BITS)))


def parting(mask: int) -> list[int]:
    """The tables that part a large group of a table: its mask, and half of the places that it doesn't compare."""
    return [mask | m for m in masks([i for i in range(BITS) if not mask >> i & 1])]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(data: bytes) -> int:
    """The fingerprint of a text in UTF-8, signed: majorities of the XXH64 of its shingles, repeats included.

    Words are parted by space and tab to carriage return, A-Z is lower-cased. With fewer words than a shingle has the
    whole sequence is one; without words the fingerprint is zero."""
    words = data.lower().split()
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - SHINGLE + 1, 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([digest(text[a:b], SEED) for a, b in spans]), np.uint8).reshape(n, 8)
    counts = sum(np.unpackbits(hashes[k : k + COUNTED], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, n, COUNTED))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The columns of docs but text as a struct ``others``, doc (the id; null: NULL_ID) and print (long)."""
    packed, _ = others(docs, "fingerprint", "component_id")
    df = docs.select(packed, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x.as_py()) for x in batch.column("data")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("others"), batch.column("doc"), prints], names=["others", "doc", "print"])

    return df.mapInArrow(run, f"others {df.schema['others'].dataType.simpleString()}, doc long, print long")


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between different fingerprints (uint64) that connect what all such links connect."""
    one, two, left = [], [], prints
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found, left = left[near], left[~near]
                one.append(np.full(len(found), at))
                two.append(found)
                waiting.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def linker(radius: int, large: int | None):
    """Turns rows (v, u, key, print), sorted, into links (v, a, b); prints of groups of over ``large`` come as (v, a, null).

    A link is left to the first table in which its two ends meet: there they are connected anyway."""
    every = np.array(TABLES, np.uint64)

    def links(v: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = forest(prints, radius)
        here = ((((a ^ b)[:, None] & every) == 0).argmax(axis=1) == v) if len(a) else np.zeros(0, bool)
        return a[here], b[here]

    def rows(v: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(a.view(np.int64)), second], names=["v", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The group that may go on in the next batch: its key, its prints, and whether it's known to be large.
        key, held, hot = None, np.zeros(0, np.uint64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            v, u, k = (batch.column(c).to_numpy() for c in ("v", "u", "key"))
            prints = batch.column("print").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(v) != 0) | (np.diff(u) != 0) | (np.diff(k) != 0)) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
            out = []
            # The first group may belong to what is held, the last may go on; of those between only several prints count.
            inner = np.flatnonzero(ends - begins > 1)
            for g in np.unique(np.concatenate([[0], inner, [len(begins) - 1]])):
                low, high = begins[g], ends[g]
                mine = (int(v[low]), int(u[low]), int(k[low]))
                if mine != key:
                    if len(held) > 1:
                        out.append((key[0], *links(key[0], held)))
                    key, held, hot = mine, prints[:0], False
                held = np.concatenate([held, prints[low:high]])
                if large is not None and (hot or len(held) > large):
                    yield rows(np.full(len(held), mine[0]), held, None)
                    held, hot = prints[:0], True
            if out := [x for x in out if len(x[1])]:
                yield rows(np.concatenate([np.full(len(a), t) for t, a, _ in out]), *(np.concatenate([x[j] for x in out]) for j in (1, 2)))
        if len(held) > 1:
            a, b = links(key[0], held)
            yield rows(np.full(len(a), key[0]), a, b)

    return run


def linked(prints: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Links (a, b) that connect different fingerprints (print long) as all links within the radius (4 at most) do."""
    def met(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.repartition("v", "u", "key").sortWithinPartitions("v", "u", "key").mapInArrow(linker(radius, most), "v int, a long, b long")

    # An array of literals gives one row for each table; the key is what the table compares.
    tables = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.lit(signed(m)).alias("mask")) for v, m in enumerate(TABLES))))
    first = prints.select("print", tables.alias("t")).select("t.v", F.lit(-1).alias("u"), F.col("print").bitwiseAND(F.col("t.mask")).alias("key"), "print")
    found = written(met(first, large), "covering-links")
    finer = [(v, u, signed(m)) for v, mask in enumerate(TABLES) for u, m in enumerate(parting(mask))]
    hot = found.where("b is null").select("v", F.col("a").alias("print"))
    second = hot.join(F.broadcast(prints.sparkSession.createDataFrame(finer, "v int, u int, mask long")), "v")
    second = second.select("v", "u", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print")
    out = written(found.where("b is not null").select("a", "b").unionByName(met(second, None).select("a", "b")).distinct(), "covering-all-links")
    dropped(found)
    return out


def groups(docs: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """The columns of docs but text, then fingerprint (16 hex digits) and component_id: the smallest doc_id among the rows
    that links within the radius connect.

    A null text is empty; texts without words have fingerprint zero and link like any other. Rows are linked by their
    texts, not by a doc_id they share; a null doc_id orders first. Other columns pass through unless named as a new one,
    which then replaces it. No rows give no rows."""
    rows = written(fingerprinted(docs), "covering-prints")
    each = written(rows.groupBy("print").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")), "covering-each")
    links = linked(each.select("print"), radius, large)
    parts = components(links, "covering-components").withColumnsRenamed({"node": "print", "component": "part"})
    least = each.join(parts, "print").groupBy("part").agg(F.min("first").alias("least"))
    classes = each.join(parts.join(least, "part").select("print", "least"), "print", "left").select("print", "n", F.coalesce("least", "first").alias("least"))
    classes = written(classes, "covering-classes")
    dropped(links)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(classes.where(F.col("n") > total // HOT).select("print", "least"))
    rest = classes.where(F.col("n") <= total // HOT).select("print", "least")
    out = rows.join(hot, "print").unionByName(rows.join(hot.select("print"), "print", "left_anti").join(rest, "print"))
    _, unpacked = others(docs, "fingerprint", "component_id")
    return out.select(*unpacked, hex_digits(F.col("print")).alias("fingerprint"), F.when(F.col("least") != NULL_ID, F.col("least")).alias("component_id"))


def hex_digits(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def op12_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and the smallest doc_id that links within 4 bits lead to."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
