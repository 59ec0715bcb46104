"""Where do fixed-length windows repeat? Windows are grouped by the smallest hashed gram inside each of them.

Every window of ``win`` units (bytes or words) is assigned to its *anchor*: the leftmost gram of ``gram`` units with
the smallest hash among all grams inside the window. Equal windows have equal anchors at equal offsets, so only the
contexts of one anchor gram need comparing. Neighbouring windows with one anchor form a *context*, a stretch of fewer
than ``2 * win`` units. There are about ``2 / (win - gram + 2)`` contexts a unit, which is what is shuffled, instead of
a row for each window.

Three steps, all of them exact:

1. ``candidates``: contexts repeated as a whole are settled by their hash; of each different context one stays.
2. Contexts that share an anchor with a different one are fetched (``texts``) and compared window by window by the
   caller's index, a bounded number of them at a time.
3. Anchors with more than ``HEAVY`` different contexts are taken apart into single windows, whose first places are
   found by an aggregate (``heavy``), so no task holds one gram's contexts together. Those that a sample shows
   (``hot_grams``) don't even meet to be counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held as kept_by_worker
from .common import written

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd number for each byte value, and the base of the polynomial hashes.
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
#: Units hashed at a time (so that the arrays stay in cache) and bytes whose contexts are settled together in a task.
PIECE, BLOCK = 1 << 15, 24 << 20
#: Different contexts of one anchor that a task may hold together.
HEAVY = 12_000
#: Documents of which one is looked at for hot grams, and hot grams (8 bytes each) that are broadcast.
SAMPLED, HOTTEST = 32, 65_536
#: Places inside a text take the low bits of a position, the key of the row (rid) the bits above.
PLACE = 36

FOUND = "ah long, ch long, doc long, pos long, l int, r int, settled boolean"


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def power(n: int) -> np.uint64:
    return U(pow(BASE, n, 1 << 64))


def doubled(h: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4 .. upto units from each place; wrong within that many of the end."""
    out, m = {1: h}, 1
    while m < upto:
        n = len(h) - m
        g = np.empty_like(h)
        np.multiply(h[:n], power(m), out=g[:n]) if n > 0 else None
        g[: max(n, 0)] += h[m:]
        g[max(n, 0) :] = 0
        out[2 * m], h, m = g, g, 2 * m
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each place; near the end, of those that are left."""
    x, m = x.copy(), 1
    while m < width:
        step = min(m, width - m)
        if step < len(x):
            y = x.copy()
            np.minimum(x[:-step], x[step:], out=y[:-step])
            x = y
        m += step
    return x


def contexts(units: np.ndarray, ends: np.ndarray, win: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie one after the other: start, end, anchor place, text number, anchor hash, context hash.

    units: a hash for each unit; ends: where each text ends."""
    block = 1 << (win.bit_length() - 1)
    begins = np.concatenate(([0], ends[:-1]))
    long = np.flatnonzero(ends - begins >= win)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none, none.astype(U), none.astype(U)
    by = doubled(units, block)
    n, width = len(units), win - gram + 1
    low = U((1 << 26) - 1)
    key = (mix(by[gram]) & ~low) | np.arange(n, dtype=U)
    least = sliding_min(key, width)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = begins[long], ends[long] - win  # the first and last window of each text
    starts = np.unique(np.concatenate((change, first)))
    which = np.searchsorted(first, starts, "right") - 1
    ok = (which >= 0) & (starts <= last[which])
    starts, which = starts[ok], which[ok]
    after = np.append(starts[1:], n)
    stop = np.minimum(after - 1, last[which]) + win
    a = (least[starts] & low).astype(np.int64)
    h = by[block]
    ch = mix(h[starts]) * U(3) + mix(h[(starts + stop - block) // 2]) * U(5) + mix(h[stop - block]) * U(7)
    ch = mix(ch + ((a - starts) * 100_003 + (stop - starts)).astype(U))
    return starts, stop, a, long[which], mix(by[gram][a]), ch


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by text and start, with those that overlap or touch joined."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    # Stops grow with starts within a text, as all spans come from windows of one length or unions of them.
    top = stop.copy()
    head = np.ones(len(doc), bool)
    head[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(head) - 1
    lift = group * (int(stop.max()) + 1)
    top = np.maximum.accumulate(stop + lift) - lift
    new[1:] = head[1:] | (start[1:] > top[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(top, at)


def byte_units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE[data], ends


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words up to its end."""
    word = ~is_space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return s, e, np.searchsorted(s, ends, "left")


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by the differences of a running polynomial sum (base odd, so its powers invert)."""
    if not len(s):
        return np.zeros(0, U)
    inverse = pow(BASE, -1, 1 << 64)
    n = len(data)
    powers = np.cumprod(np.concatenate(([U(1)], np.full(n, U(BASE)))))
    total = np.concatenate(([U(0)], np.cumsum(BYTE[data] * powers[:n])))
    back = np.cumprod(np.concatenate(([U(1)], np.full(n, U(inverse)))))
    return mix((total[e] - total[s]) * back[s] + (e - s).astype(U))


def word_units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, upto = word_places(data, ends)
    return word_hashes(data, s, e), upto


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each of its texts ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at[1:] - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts in lots of about PIECE bytes, a long text alone: which texts, their bytes, where they end."""
    i, begin = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        yield slice(i, j), data[begin : ends[j - 1]], ends[i:j] - begin
        i, begin = j, int(ends[j - 1])


def split_contexts(units: np.ndarray, ends: np.ndarray, win: int, gram: int, most: int = 1 << 25) -> tuple:
    """contexts() for any number of units: lots of ``most`` window starts. A context cut in two is two contexts."""
    if len(units) <= most:
        return contexts(units, ends, win, gram)
    out = []
    for lo in range(0, len(units), most):
        hi = min(len(units), lo + most + win - 1)
        i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left")
        to = np.append(ends[i:j], hi) - lo
        start, stop, a, text, ah, ch = contexts(units[lo:hi], to, win, gram)
        stop = np.minimum(stop, most + win - 1)  # windows that start beyond belong to the next lot
        ok = start < most
        out.append([x[ok] for x in (start + lo, stop + lo, a + lo, text + i, ah, ch)])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def rows(ah, ch, doc, rid, a, left, right, settled: bool) -> pa.RecordBatch:
    """A batch in the columns of FOUND."""
    pos = (rid.astype(np.int64) << PLACE) | a.astype(np.int64)
    cols = [ah.view(np.int64), ch.view(np.int64), doc, pos, left.astype(np.int32), right.astype(np.int32), np.full(len(doc), settled)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["ah", "ch", "doc", "pos", "l", "r", "settled"])


def by_key(key: np.ndarray, within: tuple[np.ndarray, ...]) -> np.ndarray:
    """The order by key, and by the last to the first of ``within`` where keys are equal (few are)."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    at = order[tied]
    order[tied] = at[np.lexsort((*(x[at] for x in within), key[at]))]
    return order


def finder(units: Callable, win: int, gram: int, same_text: bool) -> Callable:
    """For mapInArrow over (doc, rid, text): the contexts, those that repeat within a block settled already.

    same_text: an earlier place in the same text counts as well as one in an earlier text."""

    def settle(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        start, stop, a, doc, rid, ah, ch = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = by_key(mix(ah) ^ ch, (a, rid, doc))
        start, stop, a, doc, rid, ah, ch = (x[order] for x in (start, stop, a, doc, rid, ah, ch))
        new = np.ones(len(ah), bool)
        new[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        if same_text:  # a repeated row stands at the same place as the first: not a copy of it
            again = (doc != doc[lead]) | (rid != rid[lead]) | (a != a[lead])
            keep = new
        else:
            again = doc > doc[lead]
            keep = ~again
        yield rows(ah[keep], ch[keep], doc[keep], rid[keep], a[keep], (a - start)[keep], (stop - a)[keep], False)
        if again.any():
            ids, back = np.unique(np.stack((doc[again], rid[again])), axis=1, return_inverse=True)
            which, s, e = merged(back.reshape(-1), start[again], stop[again])
            d, r = ids[0][which], ids[1][which]
            yield rows(mix(d.astype(U) * U(31) + s.astype(U)), mix(s.astype(U)), d, r, s, np.zeros_like(s), e - s, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("anchors")
        parts, size = [], 0
        for batch in batches:
            data, ends = buffers(batch.column("text"))
            docs = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            rids = batch.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
            for which, own, to in pieces(data, ends):
                hashes, upto = units(own, to)
                start, stop, a, text, ah, ch = split_contexts(hashes, upto, win, gram)
                begin = np.concatenate(([0], upto[:-1]))[text]
                parts.append((start - begin, stop - begin, a - begin, docs[which][text], rids[which][text], ah, ch))
                size += len(own)
                if size >= BLOCK:
                    yield from settle(parts)
                    parts, size = [], 0
        if parts:
            yield from settle(parts)

    return run


def slices(units: Callable, as_words: bool) -> Callable:
    """For mapInArrow over (doc, rid, text, wanted): the contexts' bytes, or their words' hashes, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = buffers(batch.column("text"))
            begins = np.concatenate(([0], ends[:-1]))
            wanted = batch.column("wanted")
            count = np.diff(np.asarray(wanted.offsets))
            flat = wanted.flatten()
            text = np.repeat(np.arange(len(count)), count)
            ah, pos, left, right = (np.asarray(flat.field(k)) for k in ("ah", "pos", "l", "r"))
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            heavy = flat.field("heavy")
            place = pos & ((1 << PLACE) - 1)
            if as_words:
                hashes, upto = [], []
                for _, own, to in pieces(data, ends):
                    h, u = units(own, to)
                    upto.append(u + sum(map(len, hashes)) if len(upto) < 2 else u + total)
                    hashes.append(h)
                    total = int(upto[-1][-1])
                src = np.concatenate(hashes) if hashes else np.zeros(0, U)
                begins = np.concatenate(([0], np.concatenate(upto)[:-1])) if upto else begins
                src, width = src.view(np.uint8), 8
            else:
                src, width = data, 1
            s = (begins[text] + place - left) * width
            e = (begins[text] + place + right) * width
            for i in range(0, len(s), 20_000):
                n = (e - s)[i : i + 20_000]
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                take = np.arange(offsets[-1]) + np.repeat(s[i : i + 20_000] - offsets[:-1], n)
                body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(src[take])])
                k = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(ah[k]), pa.array(doc[text[k]]), pa.array(pos[k]), pa.array(left[k]), heavy[k.start : k.start + len(n)], body], names=["ah", "doc", "pos", "l", "heavy", "body"])

    return run


def compared(mark: Callable, win: int, unit: type, most: int) -> Callable:
    """For mapInArrow over contexts sorted by (ah, doc, pos): the spans of the windows that ``mark`` finds repeated.

    mark(units, ends, docs, win) gets whole anchors' contexts, about ``most`` units at a time, in order of place."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        units, ends, doc, pos, left = (np.concatenate(x) for x in zip(*held, strict=True))
        lens = np.diff(np.concatenate(([0], ends)))
        hit = np.flatnonzero(mark(units, ends, doc, win))
        text = np.searchsorted(ends, hit, "right")
        begin = ends - lens
        start = (pos[text] & ((1 << PLACE) - 1)) - left[text] + hit - begin[text]
        which, s, e = merged(text, start, start + win)
        return pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array((pos[which] >> PLACE).astype(np.int32)), pa.array(s), pa.array(e)], names=["doc", "rid", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            data, ends = buffers(batch.column("body"))
            ah, doc, pos, left = (np.asarray(batch.column(k)) for k in ("ah", "doc", "pos", "l"))
            same = np.flatnonzero((ah[1:] == ah[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])) + 1
            if len(ah) and last == (ah[0], doc[0], pos[0]):
                same = np.append(0, same)
            if len(same):  # rows that are repeated in the table
                batch = batch.take(pa.array(np.delete(np.arange(len(ah)), same)))
                data, ends = buffers(batch.column("body"))
                ah, doc, pos, left = (np.asarray(batch.column(k)) for k in ("ah", "doc", "pos", "l"))
            units, ends = data.view(unit), ends // np.dtype(unit).itemsize
            begins = np.concatenate(([0], ends[:-1]))
            edges = np.flatnonzero(np.concatenate(([last is None or ah[0] != last[0]], ah[1:] != ah[:-1]))) if len(ah) else []
            at = 0
            for i in [*edges, len(ah)]:
                if i > at:
                    held.append((units[begins[at] : ends[i - 1]], ends[at:i] - begins[at] + size, doc[at:i], pos[at:i], left[at:i]))
                    size += int(ends[i - 1] - begins[at])
                    at = i
                if i < len(ah) and size >= most:
                    yield flush(held)
                    held, size = [], 0
            last = (ah[-1], doc[-1], pos[-1]) if len(ah) else last
        if held:
            yield flush(held)

    return run


def single_windows(win: int, unit: type) -> Callable:
    """For mapInArrow over heavy contexts: a row for each window, with 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 1 << (win.bit_length() - 1)
        for batch in batches:
            data, ends = buffers(batch.column("body"))
            units, ends = data.view(unit), ends // np.dtype(unit).itemsize
            h = doubled(BYTE[units] if unit is np.uint8 else units, block)[block]
            begins = np.concatenate(([0], ends[:-1]))
            n = np.maximum(ends - begins - win + 1, 0)
            text = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            i = begins[text] + at
            one, two = mix(h[i]) * U(3) + mix(h[i + win - block]), mix(h[i] * U(5) + U(1)) ^ mix(h[i + win - block] + U(9))
            doc, pos, left = (np.asarray(batch.column(k)) for k in ("doc", "pos", "l"))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc[text]), pa.array(pos[text] - left[text] + at)], names=["one", "two", "doc", "pos"])

    return run


def hot_grams(docs: DataFrame, units: Callable, win: int, gram: int, same_text: bool, heavy: int) -> DataFrame:
    """ah and hot (true) of the grams that one document of SAMPLED shows to have more than ``heavy`` contexts; HOTTEST at most.

    It only tells which grams are taken apart before they meet in a task; grams that it misses are taken apart after."""
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).mapInArrow(finder(units, win, gram, same_text), FOUND)
    times = some.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy // SAMPLED)
    return times.orderBy(F.desc("n"), "ah").limit(HOTTEST).select("ah", F.lit(True).alias("hot"))


def repeats(docs: DataFrame, units: Callable, win: int, gram: int, mark: Callable, same_text: bool, most: int, heavy: int = HEAVY) -> DataFrame:
    """(doc, rid, s, e): spans of units, covered by windows that occur at an earlier place. docs: doc, rid, text."""
    as_words = units is not byte_units
    unit = U if as_words else np.uint8
    found = docs.mapInArrow(finder(units, win, gram, same_text), FOUND)
    found = found.join(F.broadcast(hot_grams(docs, units, win, gram, same_text, heavy)), "ah", "left").withColumn("part", F.when(F.col("hot"), F.pmod("ch", F.lit(4096))).otherwise(0))
    # One exchange by anchor serves all window functions; hot contexts were reduced to a row a block before it, and a hot
    # gram's contexts are dealt out by what they hold.
    group, run = Window.partitionBy("ah", "part"), Window.partitionBy("ah", "part", "ch").orderBy("doc", "pos")
    lead = F.first(F.struct("doc", "pos")).over(run)
    seen = found.withColumns({"lead": lead, "several": F.min("ch").over(group) != F.max("ch").over(group), "n": F.count(F.lit(1)).over(group)})
    later = (F.struct("doc", "pos") > F.col("lead")) if same_text else (F.col("doc") > F.col("lead.doc"))
    seen = seen.withColumn("again", F.col("settled") | later)
    hot = F.coalesce("hot", F.lit(False))
    kept = seen.where(F.col("again") | F.col("several") | hot).select("ah", "doc", "pos", "l", "r", "again", (hot | (F.col("n") > heavy)).alias("heavy"))
    kept = written(kept, "contexts")
    place, rid = F.col("pos").bitwiseAND((1 << PLACE) - 1), F.shiftright("pos", PLACE).cast("int").alias("rid")
    whole = kept.where("again").select("doc", rid, (place - F.col("l")).alias("s"), (place + F.col("r")).alias("e"))

    rest = kept.where("not again").select("doc", rid, F.struct("ah", "pos", "l", "r", "heavy").alias("x"))
    wanted = rest.groupBy("doc", "rid").agg(F.collect_set("x").alias("wanted"))
    bodies = docs.join(wanted, ["doc", "rid"]).mapInArrow(slices(units, as_words), "ah long, doc long, pos long, l int, heavy boolean, body binary")
    bodies = written(bodies, "bodies")
    light = bodies.where("not heavy").repartition("ah").sortWithinPartitions("ah", "doc", "pos")
    near = light.mapInArrow(compared(mark, win, unit, most), "doc long, rid int, s long, e long")

    each = bodies.where("heavy").mapInArrow(single_windows(win, unit), "one long, two long, doc long, pos long")
    lead = each.groupBy("one", "two").agg(F.min(F.struct("doc", "pos")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (F.struct("doc", "pos") > F.col("lead")) if same_text else (F.col("doc") > F.col("lead.doc"))
    apart = each.join(lead, ["one", "two"]).where(later).select("doc", rid, place.alias("s"), (place + win).alias("e"))
    return whole.unionByName(near).unionByName(apart)
