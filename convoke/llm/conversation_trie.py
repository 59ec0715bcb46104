"""The prefix trie of conversations, from the longest common prefixes of the sorted conversations.

Conversations are sorted by their turns (by hashes of them: any order serves that keeps common prefixes together). The
sorted rows lie in blocks, one for each range of the sort. What two neighbours share is the value of the place between
them; the Cartesian tree over these values has a node for each stretch of conversations that share more than those
around it. Each task finds the nearest smaller values of its block on both sides with a stack; stretches that leave
the block are settled by what each block says about itself: its first and last row, and for each depth its last place
with a smaller value (its minimum is where these end). Places of one stretch and one value are one node; the depths
between a node and the one above it have the same stretch. A node's figures are sums over its stretch, as every row
holds its own share: what it saves is the text it has in common with the row before it, a child is a row that shares
less than it has, a leaf a row that the next one doesn't go on from. Stretches over several blocks are added up.

A conversation isn't held in one row but in chunks of CHUNK turns, the last one short or empty. Chunks meet only those
with the same hash of all turns before, so every chunk's trie hangs below a node of the one before; what lies deeper is
added to a conversation's earlier chunks by a window over its chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, written

#: Turns of a conversation in a row; conversations led by another's first turns; turns (by number) ranked in one group.
CHUNK, FAMILY, RANKED = 64, 20, 1024

#: Ids in one piece of a list that several blocks hash.
PIECE = 4096

EMPTY = hashlib.sha256(b"").hexdigest()


def leader(conv: Column) -> Column:
    """The conversation whose first turns another may begin with: the multiple of FAMILY at or below its id."""
    return conv - F.pmod(conv, F.lit(FAMILY))


def ranked(conversations: DataFrame) -> DataFrame:
    """Turns with their number rn: conv, rn, a and b (hashes of role and text), w (words), and of their conversation
    h (turns that its leader may give), m (that it does give) and total (turns when rebuilt).

    Turns of equal number (null first) are in order of their hashes; rows without conv_id belong to none and are left out."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    part = F.coalesce(F.floor(F.col("turn") / RANKED).cast("long"), F.lit(-(2**63)))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), part.alias("part"), "turn",
        F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"),
    )
    counts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("conv")
    counts = counts.withColumns({
        "before": F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "own": F.sum("n").over(by),
        "h": F.crc32(F.col("conv").cast("string").cast("binary")) % 4,
        "leader": leader(F.col("conv")),
    })
    leads = counts.where("conv = leader and before = 0").select("leader", F.col("own").alias("led"))
    counts = counts.join(leads, "leader", "left").withColumn("m", F.least("h", F.coalesce("led", F.lit(0))))
    counts = counts.select("conv", "part", "before", "h", "m", (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("m")).alias("total"))
    rn = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "a", "b")) + F.col("before")
    return rows.join(counts, ["conv", "part"]).select("conv", rn.alias("rn"), "a", "b", "w", "h", "m", "total")


def chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """A row for each chunk of a rebuilt conversation: conv, k (its number), g1 and g2 (a hash of all turns before), keys
    (a and b of its turns), ws (words of the turn before the chunk, then of each), last (no chunk follows), and own1,
    own2, up1, up2: the hashes of the turns up to all but its last, and up to all but the last before it."""
    heads = turns.where((F.col("conv") == leader(F.col("conv"))) & (F.col("rn") <= 3))
    heads = heads.groupBy(F.col("conv").alias("leader")).agg(F.array_sort(F.collect_list(F.struct("rn", "a", "b", "w"))).alias("led"))
    own = turns.where("rn > h").select("conv", (F.col("rn") - F.col("h") + F.col("m")).alias("pos"), "a", "b", "w")
    firsts = turns.where("rn = 1")
    given = firsts.where("m > 0").withColumn("leader", leader(F.col("conv"))).join(heads, "leader")
    given = given.select("conv", F.explode(F.slice("led", 1, F.col("m").cast("int"))).alias("t")).select("conv", F.col("t.rn").alias("pos"), "t.a", "t.b", "t.w")
    rows = own.unionByName(given)
    # The last turn of a full chunk is also what stands before the next.
    k = (F.col("pos") - 1) / chunk
    both = F.array(F.floor(k), F.when(F.col("pos") % chunk == 0, F.floor(k) + 1))
    rows = rows.select("*", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("k")).withColumn("i", F.col("pos") - F.col("k") * chunk)
    ends = firsts.select("conv", F.floor(F.col("total") / chunk).alias("k"), F.lit(True).alias("last"))
    one, two, inside = F.xxhash64("pos", "a", "b"), F.xxhash64("b", "pos", "a"), F.col("i") >= 1
    rows = rows.unionByName(ends, allowMissingColumns=True).groupBy("conv", "k").agg(
        F.array_sort(F.collect_list(F.when(inside, F.struct("i", "a", "b", "w")))).alias("e"),
        F.coalesce(F.max(F.when(F.col("i") == 0, F.col("w"))), F.lit(0)).alias("w"),
        F.coalesce(F.bool_or("last"), F.lit(False)).alias("last"),
        *(F.coalesce(F.bit_xor(F.when(inside, x)), F.lit(0)).alias(f"all{j}") for j, x in ((1, one), (2, two))),
        *(F.coalesce(F.bit_xor(F.when(inside & (F.col("i") < chunk), x)), F.lit(0)).alias(f"most{j}") for j, x in ((1, one), (2, two))),
        *(F.coalesce(F.bit_xor(F.when(F.col("i") == 0, x)), F.lit(0)).alias(f"lead{j}") for j, x in ((1, one), (2, two))),
    )
    before = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"g{j}": F.coalesce(F.bit_xor(f"all{j}").over(before), F.lit(0)) for j in (1, 2)})
    return rows.select(
        "conv", "k", "g1", "g2", F.transform("e", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("keys"),
        F.concat(F.array("w"), F.col("e.w")).alias("ws"), "last",
        *(F.col(f"g{j}").bitwiseXOR(F.col(f"most{j}")).alias(f"own{j}") for j in (1, 2)),
        *(F.col(f"g{j}").bitwiseXOR(F.col(f"lead{j}")).alias(f"up{j}") for j in (1, 2)),
    )


def shared(groups: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Leading keys that each row but the first has in common with the one before it; -1 in another group."""
    n = np.diff(offsets)
    most = np.minimum(n[1:], n[:-1])
    alive = np.flatnonzero((groups[1:] == groups[:-1]).all(axis=1))
    out = np.full(len(most), -1, np.int64)
    out[alive] = 0
    depth = 0
    while len(alive := alive[most[alive] > depth]):
        alive = alive[(keys[offsets[alive] + depth] == keys[offsets[alive + 1] + depth]).all(axis=1)]
        depth += 1
        out[alive] = depth
    return out


SLIM = "conv long, k long, ws array<int>, last boolean, own1 long, own2 long, up1 long, up2 long"
BLOCKED = f"{SLIM}, block int, at long, lcp int, following int, rows long, first binary, final binary, tails array<long>"


def neighbours(chunk: int):
    """Rows of a block, sorted, without their keys but with lcp (what they share with the row before) and following (what
    the next shares with them), null where that is in another block. Last comes a row that speaks for the block: rows,
    first, final (their groups and keys), and tails: for each depth the last row, but the first, that shares less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        first, tails, done, block = None, np.full(chunk + 1, -1, np.int64), 0, None
        waiting, edge = None, None
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            block = batch.column("block")[0].as_py()
            groups = np.stack([batch.column(c).to_numpy() for c in ("k", "g1", "g2")], axis=1)
            lists = batch.column("keys")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            struct = lists.values
            keys = np.stack([struct.field(j).to_numpy() for j in range(2)], axis=1)
            if edge is not None:
                groups, keys = np.concatenate([edge[0], groups]), np.concatenate([edge[1], keys[offsets[0] :]])
                offsets = np.concatenate([[0], offsets - offsets[0] + len(edge[1])])
            lcp = shared(groups, offsets, keys)
            if edge is None:
                first = np.concatenate([groups[0], keys[offsets[0] : offsets[1]].ravel()]).tobytes()
                at = done + 1 + np.arange(len(lcp))
            else:
                at = done + np.arange(len(lcp))
            for depth in range(chunk + 1):
                less = np.flatnonzero(lcp < depth)
                if len(less):
                    tails[depth] = at[less[-1]]
            edge = groups[-1:], keys[offsets[-2] : offsets[-1]]
            mine = pa.array(lcp, pa.int32()) if len(lcp) == n else pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(lcp, pa.int32())])
            cols = [batch.column(c.split(" ")[0]) for c in SLIM.split(", ")]
            cols += [batch.column("block"), pa.array(done + np.arange(n)), mine]
            if waiting is not None:
                yield complete(waiting, pa.concat_arrays([waiting[-1][1:], mine[:1]]))
            waiting, done = cols, done + n
        if waiting is not None:
            yield complete(waiting, pa.concat_arrays([waiting[-1][1:], pa.nulls(1, pa.int32())]))
            kinds = [c.type for c in waiting]
            final = np.concatenate([edge[0][0], edge[1].ravel()]).tobytes()
            cols = [*(pa.nulls(1, t) for t in kinds[:-3]), pa.array([block], pa.int32()), pa.array([-1]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())]
            yield named([*cols, pa.array([done]), pa.array([first], pa.binary()), pa.array([final], pa.binary()), pa.array([tails.tolist()], pa.list_(pa.int64()))])

    def complete(cols: list, following: pa.Array) -> pa.RecordBatch:
        n = len(following)
        return named([*cols, following, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))])

    def named(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(cols, names=[c.strip().split(" ")[0] for c in BLOCKED.split(", ")])

    return run


def borders(blocks: list, chunk: int) -> list[tuple[int, int, int, int, list[int]]]:
    """Of each block (block, rows, first, final, tails), in order: its number, its last row's, what its first row shares
    with the row before, what the next block's first row shares with its last, and where each of the nodes starts that
    its first row shares with the row before, by depth. A place is block * 2^32 + row."""
    read = lambda x: np.frombuffer(x, np.int64)
    out, start, before = [], np.full(chunk + 1, -1, np.int64), None
    for block, rows, first, final, tails in sorted(blocks):
        value, mine = -1, read(first)
        if before is not None and (before[:3] == mine[:3]).all():
            n = min(len(before), len(mine))
            same = (before[3:n] == mine[3:n]).reshape(-1, 2).all(axis=1)
            value = int(np.append(same, False).argmin())
        out.append([block, rows - 1, value, -1, start[: value + 1].tolist()])
        if len(out) > 1:
            out[-2][3] = value
        tails = np.array(tails)
        tails = np.where((tails < 0) & (np.arange(chunk + 1) > value), 0, tails)
        start = np.where(tails >= 0, block * 2**32 + tails, start)
        before = read(final)
    return [tuple(x) for x in out]


def nearest_smaller(values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the first one of its node (of those with its value and no smaller one in between), and for these
    the nearest places before and after the node with a smaller value (-1, len: none): left, right, first."""
    n = len(values)
    left, right, same, stack = [-1] * n, [n] * n, list(range(n)), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[same[stack.pop()]] = i
        if stack and values[stack[-1]] == v:
            same[i] = same[stack.pop()]
        else:
            left[i] = stack[-1] if stack else -1
        stack.append(i)
    return np.array(left), np.array(right), np.array(same)


NODES = "start long, depth long, whole boolean, conv long, n long, children long, leaves long, saved long, parent long, up long, key1 long, key2 long, top boolean, ends string, piece_of long, piece binary"


def block_nodes(block: int, cols: dict, chunk: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a block: whole ones, and its share of those that go beyond it (one row for each piece of their list
    of ends; the figures stand in the first)."""
    conv, k, last = (cols[c].to_numpy(zero_copy_only=False) for c in ("conv", "k", "last"))
    n = len(conv)
    lists = cols["ws"]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = np.concatenate([[0], np.cumsum(lists.values.to_numpy().astype(np.int64))])
    length = np.diff(offsets) - 1
    values = np.concatenate([cols["lcp"].to_numpy(), cols["following"].to_numpy()[-1:]]).astype(np.int64)
    starts = np.array(cols["starts"][0].as_py() or [], np.int64)

    left, right, same = nearest_smaller(values.tolist())
    own = np.flatnonzero((same == np.arange(n + 1)) & (values >= 0))
    node_of = np.full(n + 1, -1)
    node_of[own] = np.arange(len(own))
    beside = lambda at: np.where((at >= 0) & (at <= n), values[np.clip(at, 0, n)], -1)
    above = np.maximum(beside(left[own]), beside(right[own]))
    from_left = (left[own] >= 0) & (beside(left[own]) == above)
    over = np.where(from_left, left[own], right[own])
    # Then rows on their own, deeper than what they share with either neighbour.
    lone_above = np.maximum(values[:-1], values[1:])
    lone_over = np.where(values[:-1] == lone_above, np.arange(n), np.arange(1, n + 1))
    low = np.concatenate([np.maximum(left[own], 0), np.arange(n)])
    high = np.concatenate([np.minimum(right[own], n), np.arange(1, n + 1)])
    begun = np.concatenate([left[own] >= 0, np.ones(n, bool)])
    whole = begun & np.concatenate([right[own] <= n, np.ones(n, bool)])
    value = np.concatenate([values[own], length])
    above = np.concatenate([above, lone_above])
    over = np.concatenate([over, lone_over])
    over = np.where(above >= 0, node_of[same[np.clip(over, 0, n)]], -1)

    kids = np.zeros(len(value), np.int64)
    new = (values[:-1] >= 0) & (length > values[:-1])
    np.add.at(kids, node_of[same[:-1][new]], 1)
    kids[: len(own)] += begun[: len(own)] & (length[low[: len(own)]] > value[: len(own)])
    least = np.minimum.reduceat(np.append(conv, 0), np.stack([low, high], axis=1).ravel())[::2]
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    shares = words[offsets[:-1] + np.minimum(values[:-1], chunk - 1) + 1] - words[offsets[:-1]]
    saved, deeper = running(shares), running(cols["more_saved"].to_numpy())
    leaves = running((last & (values[1:] < length)).astype(np.int64) + cols["more_leaves"].to_numpy())

    depths = np.maximum(np.minimum(value, chunk - 1) - above, 0)
    of = np.repeat(np.arange(len(value)), depths)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(depths) - depths, depths) + above[of] + 1
    lo, hi, here = low[of], high[of], begun[of].astype(np.int64)
    children = np.where(depth < value[of], here, kids[of])
    above_words = words[offsets[lo] + depth] - words[offsets[lo]]
    saves = saved[hi] - saved[lo] - here * shares[lo] - (hi - lo - here) * above_words + deeper[hi] - deeper[lo]
    place = lambda at, d, inside: np.where(inside, block * 2**32 + at, starts[np.clip(d, 0, len(starts) - 1)] if len(starts) else -1)
    start = place(lo, depth, begun[of])
    chained = depth > above[of] + 1
    parent_of = np.where(chained, of, over[of])
    orphan = parent_of < 0
    known = ~orphan & whole[parent_of]
    parent, up = least[parent_of], place(low[parent_of], depth - 1, begun[parent_of])

    fresh = np.append(True, ~((values[1:-1] == length[1:]) & (length[1:] == length[:-1])))
    run_end = np.append(np.flatnonzero(fresh), n)[np.cumsum(fresh)]
    ending = np.flatnonzero(length[lo] == depth)
    ends, pieces = np.full(len(of), EMPTY, object), []
    for j in ending.tolist():
        ids = conv[lo[j] : min(run_end[lo[j]], hi[j])].tolist()
        if whole[of[j]]:
            ends[j] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        else:
            pieces += [(j, ids[p], ",".join(map(str, ids[p : p + PIECE])).encode()) for p in range(0, len(ids), PIECE)]

    key = [np.where(depth == 0, cols[f"up{j}"].to_numpy()[lo], cols[f"own{j}"].to_numpy()[lo]) for j in (1, 2)]
    keyless = ~(((depth == 0) & (k[lo] > 0)) | (depth == chunk - 1))
    part = ~whole[of]
    out = [
        pa.array(start), pa.array(k[lo] * chunk + depth), pa.array(whole[of]), pa.array(least[of]), pa.array(hi - lo), pa.array(children),
        pa.array(leaves[hi] - leaves[lo]), pa.array(saves), pa.array(parent, mask=~known), pa.array(up, mask=orphan | known),
        *(pa.array(x, mask=keyless) for x in key), pa.array(depth == 0), pa.array(ends.tolist(), pa.string(), mask=part),
        pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.binary()),
    ]
    names = [c.split(" ")[0] for c in NODES.split(", ")]
    yield pa.RecordBatch.from_arrays(out, names=names)
    if pieces:
        at = pa.array([p[0] for p in pieces])
        spare = [c.take(at) if name in ("start", "depth", "whole") else pa.nulls(len(pieces), c.type) for name, c in zip(names[:-2], out, strict=False)]
        yield pa.RecordBatch.from_arrays([*spare, pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.binary())], names=names)


def trees(chunk: int):
    """Sorted rows of one or several blocks, turned to their nodes block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high > low:
                    if held and held[-1].column("block")[-1].as_py() != block[low]:
                        yield from nodes(held)
                        held = []
                    held.append(batch.slice(low, high - low))
        if held:
            yield from nodes(held)

    def nodes(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        cols = {c: whole.column(c).chunk(0) for c in whole.column_names}
        lists = cols["ws"]
        cols["ws"] = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()), lists.flatten())
        yield from block_nodes(cols["block"][0].as_py(), cols, chunk)

    return run


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (start, depth, piece_of, piece) in order, as one digest (start, depth, ends) of each node's, joined by commas."""
    key, digest, done = None, None, []
    for batch in batches:
        for start, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("start", "depth", "piece")), strict=True):
            if (start, depth) != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = (start, depth), hashlib.sha256(piece)
            else:
                digest.update(b"," + piece)
    if key:
        done.append((*key, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["start", "depth", "ends"])


def trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turn, role, text), after the first turns of each were replaced
    by its leader's: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty, turns without number come first, and those that tie are in order of their hashes (equal
    ones count each). Rows without conv_id are left out; other columns play no part. No conversations give no nodes,
    not even the root. Turns are told apart by 128 bits."""
    if chunk < 2:
        raise ValueError("a chunk holds two turns at least")
    turns = written(ranked(conversations), "trie-turns")
    ordered = ["k", "g1", "g2", "keys", "conv"]
    rows = chunks(turns, chunk).repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("block", F.spark_partition_id())
    rows = written(rows.mapInArrow(neighbours(chunk), BLOCKED), "trie-rows")
    dropped(turns)
    # One row for each block, of a fixed size: the number of blocks is the sort's number of partitions.
    found = borders([tuple(r) for r in rows.where("at = -1").select("block", "rows", "first", "final", "tails").collect()], chunk)
    edges = F.broadcast(conversations.sparkSession.createDataFrame(found, "block int, final_at long, value int, next_value int, starts array<long>"))
    kept = [c.split(" ")[0] for c in SLIM.split(", ")]
    rows = rows.where("at >= 0").select(*kept, "block", "at", "lcp", "following").join(edges, "block")
    rows = rows.withColumns({
        "lcp": F.when(F.col("at") == 0, F.col("value")).otherwise(F.col("lcp")),
        "following": F.when(F.col("at") == F.col("final_at"), F.col("next_value")).otherwise(F.col("following")),
        "starts": F.when(F.col("at") == 0, F.col("starts")),
    }).drop("value", "next_value", "final_at")
    # What the deeper chunks of a conversation save, and whether it ends in a leaf there, counts above them too.
    share = F.aggregate(F.slice("ws", 1, F.least("lcp", F.lit(chunk - 1)) + 1), F.lit(0).cast("long"), lambda x, y: x + y)
    leaf = (F.col("last") & (F.col("following") < F.size("ws") - 1)).cast("long")
    deeper = Window.partitionBy("conv").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    more = rows.where("not (k = 0 and last)").select("conv", "k", share.alias("saved"), leaf.alias("leaf"))
    more = more.select("conv", "k", F.sum("saved").over(deeper).alias("more_saved"), F.sum("leaf").over(deeper).alias("more_leaves"))
    rows = rows.join(more, ["conv", "k"], "left").fillna(0, ["more_saved", "more_leaves"])
    rows = rows.repartition("block").sortWithinPartitions("block", "at")
    return joined(written(rows.mapInArrow(trees(chunk), NODES), "trie-nodes"))


def joined(nodes: DataFrame) -> DataFrame:
    """Nodes with their shares of several blocks added up, and with their parents."""
    parts = nodes.where("not whole")
    sums = parts.groupBy("start", "depth").agg(F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), *(F.max(c).alias(c) for c in ("up", "key1", "key2", "top")))
    pieces = parts.where("piece is not null").select("start", "depth", "piece_of", "piece").repartition("start", "depth").sortWithinPartitions("start", "depth", "piece_of")
    sums = sums.join(pieces.mapInArrow(hashed, "start long, depth long, ends string"), ["start", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY)))
    # Nodes over several blocks: at most one a depth of a chunk at each border between blocks.
    sums = written(sums, "trie-sums")
    over = sums.select(F.col("start").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent"))
    every = sums.join(over, ["up", "depth"], "left")
    whole = nodes.where("whole")
    loose = whole.where("up is not null").drop("parent").join(F.broadcast(over), ["up", "depth"], "left")
    out = ["conv", "depth", "parent", "n", "children", "leaves", "saved", "ends", "key1", "key2", "top"]
    every = every.select(out).unionByName(loose.select(out)).unionByName(whole.where("up is null").select(out))
    # The first node of a later chunk hangs below one of the chunk before: the one with its hash.
    hung = F.col("top") & (F.col("depth") > 0)
    penult = every.where(~hung & F.col("key1").isNotNull()).select((F.col("depth") + 1).alias("depth"), "key1", "key2", F.col("conv").alias("parent"))
    every = every.where(~hung).unionByName(every.where(hung).drop("parent").join(penult, ["depth", "key1", "key2"], "left").select(out))
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node of the trie of all rebuilt conversations: its figures and the digest of the conversations that end there."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
with o as (select distinct conv_id, conv_id - ((conv_id % 20) + 20) % 20 as leader, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc from conversations where conv_id is not null),
h as (select conv_id, leader, xor(crc, 4294967295) % 4 as h from o),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) as t,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w from conversations where conv_id is not null),
r as (select h.conv_id, 0 as own, rn, t, w from h join t on t.conv_id = h.leader and rn <= h.h
  union all select h.conv_id, 1, rn, t, w from h join t on t.conv_id = h.conv_id and rn > h.h),
s as (select h.conv_id, coalesce(any_value(l.t), []) as t, coalesce(any_value(l.w), []) as w from h
  left join (select conv_id, list(t order by own, rn) as t, list(w order by own, rn) as w from r group by conv_id) l using (conv_id) group by h.conv_id),
p as (select conv_id, len(t) as n, unnest(range(0, len(t) + 1)) as d, t, w from s),
e as (select conv_id, n, d, t[1 : d] as node, case when d > 0 then t[1 : d - 1] end as up, case when d > 0 then w[d] else 0 end as w from p),
n as (select d, node, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(w) as saves,
  sha256(coalesce(string_agg(case when n = d then conv_id::varchar end, ',' order by conv_id), '')) as ends from e group by d, node),
c as (select up as node, d - 1 as d, count(*) as n_children from n where d > 0 group by up, d),
x as (select n.*, coalesce(n_children, 0) as n_children from n left join c on c.d = n.d and c.node = n.node),
b as (select e.d, e.node, sum(case when x.n_children = 0 then 1 else 0 end) as n_leaves, sum(x.saves) as saved from x join e on e.conv_id = x.conv_id and e.d <= x.d group by e.d, e.node)
select x.conv_id, x.d::bigint as depth, u.conv_id as parent_conv_id, x.n_convs, x.n_children::bigint as n_children, b.n_leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, x.ends as ends_sha256
from x join b on b.d = x.d and b.node = x.node left join x u on u.d = x.d - 1 and u.node = x.up
"""
