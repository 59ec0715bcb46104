"""Exact dedup: a cuckoo-filter index of live digests over bucketed content.

Digests of the normalised texts are dealt to shards by their hash, after each task has reduced its own rows to one
claim a digest. A shard keeps a cuckoo filter (two buckets of four 16-bit fingerprints for each digest) in front of the
full digests, stored by bucket. A claim that the filter doesn't know is inserted; a hit is verified against the stored
digests of its buckets, and if the new claim is the better one the old entry is deleted and the new one inserted. When
an insertion finds no room the filter is doubled and refilled from the stored digests, so no entry is ever lost. The
entries that are live in the end say which row of each group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, table, written

SLOTS, KICKS = 4, 64


class CuckooIndex:
    """Digests (bytes) with a value each, behind a cuckoo filter that supports deletion."""

    def __init__(self, buckets: int = 64):
        self.stored: dict[int, list[list]] = {}
        self.count = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[8:16], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 7)) & self.mask

    @staticmethod
    def _home(digest: bytes) -> int:
        return int.from_bytes(digest[8:12], "little")

    def maybe(self, digest: bytes) -> bool:
        """False if the digest is surely absent."""
        mark, one, two = self._places(digest)
        return mark in self.table[one] or mark in self.table[two]

    def find(self, digest: bytes) -> list | None:
        """The stored entry [digest, value] of a digest: a filter hit, verified."""
        if not self.maybe(digest):
            return None
        return next((e for e in self.stored.get(self._home(digest), ()) if e[0] == digest), None)

    def insert(self, digest: bytes, value: tuple) -> None:
        """Adds a digest that isn't stored."""
        self.stored.setdefault(self._home(digest), []).append([digest, value])
        self.count += 1
        if not self._place(digest):
            self._resize()

    def delete(self, digest: bytes) -> tuple | None:
        """Takes a live digest out; its value, or None if it isn't stored."""
        entry = self.find(digest)
        if entry is None:
            return None
        held = self.stored[self._home(digest)]
        held.remove(entry)
        if not held:
            del self.stored[self._home(digest)]
        mark, one, two = self._places(digest)
        self.table[one if mark in self.table[one] else two].remove(mark)
        self.count -= 1
        return entry[1]

    def _place(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for at in (one, two):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = one
        for kick in range(KICKS):
            bucket = self.table[at]
            bucket[kick % SLOTS], mark = mark, bucket[kick % SLOTS]
            at = self._other(at, mark)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def _resize(self) -> None:
        """Twice the buckets (or more), refilled from the stored digests."""
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            if all(self._place(e[0]) for held in self.stored.values() for e in held):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for held in self.stored.values():
            for digest, value in held:
                yield digest, value


def claim(index: CuckooIndex, digest: bytes, length: int, doc: int, n: int, ties: int) -> None:
    """Enters n rows with a digest, of which ``ties`` are the best: with ``length`` code points and the id ``doc``."""
    entry = index.find(digest)
    if entry is None:
        index.insert(digest, (length, doc, n, ties))
        return
    old_length, old_doc, old_n, old_ties = entry[1]
    if (length, -doc) > (old_length, -old_doc):
        index.delete(digest)
        index.insert(digest, (length, doc, old_n + n, ties))
    else:
        entry[1] = (old_length, old_doc, old_n + n, old_ties + ties * ((length, doc) == (old_length, old_doc)))


CLAIMS = "digest binary, length long, doc long, n long, ties long"

#: Texts with over 1/HOT of the rows each are fewer than HOT: so many are broadcast. Claims (some 400 bytes each) of a shard.
HOT, SHARD = 65_536, 200_000


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims of a task or shard through its own index; those that are live in the end."""
    index = CuckooIndex()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            claim(index, *row)
    digests, values = [], []
    for digest, value in index.items():
        digests.append(digest)
        values.append(value)
    if digests:
        cols = [pa.array(x, pa.int64()) for x in zip(*values, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *cols], names=["digest", "length", "doc", "n", "ties"])


def groups(documents: DataFrame) -> DataFrame:
    """One row per document: its columns but text, then keep_id, group_size, kept and text_sha256.

    Texts are equal when equal without the characters space and tab to carriage return; a null text is empty. Of equal
    texts the row with the most code points stays, of those the one with the smallest doc_id (null before all others), and
    of rows that tie in both the one whose text, then whose other columns come first by their hash: one row a group. Other
    columns pass through unless named as one of the new ones, which then replaces it.

    The groups' claims are written down; the few texts that hold very many rows each are broadcast, so that their rows
    stay where they are."""
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    text = F.coalesce(F.col("text"), F.lit(""))
    others = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")).alias("others")
    rows = documents.select(
        others,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.length(text).cast("long").alias("length"),
        F.xxhash64(text).alias("own"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("digest"),
    )
    one = F.lit(1).cast("long")
    claims = rows.select("digest", "length", "doc", one.alias("n"), one.alias("ties")).mapInArrow(indexed, CLAIMS)
    shards = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + documents.count() // SHARD)
    best = claims.repartition(shards, "digest").mapInArrow(indexed, CLAIMS)
    best = written(best.select("digest", F.col("length").alias("most"), F.col("doc").alias("keep"), F.col("n").alias("group_size"), "ties"), "digests")
    bound = (best.agg(F.sum("group_size")).first()[0] or 0) // HOT
    hot = F.broadcast(best.where(F.col("group_size") > bound))
    out = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(best.where(F.col("group_size") <= bound), "digest"))
    out = out.withColumn("kept", (F.col("length") == F.col("most")) & (F.col("doc") == F.col("keep")))
    # Rows that tie (they repeat a doc_id) are few; only they are ranked.
    first = F.row_number().over(Window.partitionBy("digest").orderBy("own", F.xxhash64("others"))) == 1
    out = out.where("not kept or ties = 1").unionByName(out.where("kept and ties > 1").withColumn("kept", first))
    out = out.select("others", F.when(F.col("keep") != NULL_ID, F.col("keep")).alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    return out.select(*(F.col(f"others.`{c}`") for c in documents.columns if c != "text" and c.lower() not in new), *new)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the id of the row of its group that stays, the group's size and digest."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
w as (
  select doc_id, norm, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
         row_number() over (partition by norm order by length(text) desc, doc_id, text) = 1 as kept
  from d)
select doc_id, keep_id, group_size, kept, sha256(norm) as text_sha256 from w
"""
