"""Fill-in-middle: documents cut at unit boundaries and put together again as prefix, suffix, middle.

A unit is a run of ASCII letters or any other single character. One scan runs a byte automaton, given by tables, over
a batch's texts: its moves mark where characters and units begin and where a sentinel ends, and the marks are counted
per text and per block of bytes. How many units a text has decides where it is cut; a second pass reads the marks of
the blocks that hold the cuts and finds their bytes.

The automaton forgets: whatever state it starts in, after DEPTH bytes it is in the one that these bytes lead to. So all
bytes of a slice are moved at once, each from DEPTH bytes before it, in place of one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, table

#: Sentinels: the prefix, the suffix, the middle follows. Texts that hold one stay as they are.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: States: after anything else; in a run of letters; after "<"; after "<" and one of P, S, M (also in a run of letters).
OTHER, LETTERS, OPENED, NAMED = range(4)
#: Marks of a move: a character begins, a unit begins, a sentinel ends.
CHARACTER, UNIT, SENTINEL = 1, 2, 4

#: Bytes that are moved at once, and bytes whose marks are counted together.
SLICE, BLOCK = 1 << 20, 1 << 14


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the marks for each (state, byte), as flat tables."""
    state, mark = np.full((4, 256), OTHER, np.uint8), np.full((4, 256), CHARACTER | UNIT, np.uint8)
    letters = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]
    state[:, letters] = LETTERS
    mark[LETTERS, letters] = mark[NAMED, letters] = CHARACTER
    state[:, ord("<")] = OPENED
    state[OPENED, [PREFIX[1], SUFFIX[1], MIDDLE[1]]] = NAMED
    mark[NAMED, ord(">")] |= SENTINEL
    mark[:, 0x80:0xC0] = 0
    return state.ravel(), mark.ravel()


MOVES, MARKS = automaton()


def memory(moves: np.ndarray, most: int = 8) -> int:
    """After how many bytes the state no longer depends on the one at the start."""
    reached = {tuple(range(len(moves) // 256))}
    for depth in range(most):
        if all(len(set(states)) == 1 for states in reached):
            return depth
        reached = {tuple(int(moves[s * 256 + b]) for s in states) for states in reached for b in range(256)}
    raise ValueError("the automaton doesn't forget where it started")


DEPTH = memory(MOVES)


def marks(data: np.ndarray, starts: np.ndarray, low: int, high: int) -> np.ndarray:
    """The marks of data[low:high] in which texts start at ``starts`` (ascending)."""
    first = max(low - DEPTH, 0)
    seen = data[first:high].astype(np.uint16)
    state = np.zeros(len(seen), np.uint8)
    for _ in range(DEPTH):
        state[1:] = MOVES[(state[:-1].astype(np.uint16) << 8) | seen[:-1]]
    inside = starts[np.searchsorted(starts, first) : np.searchsorted(starts, high)] - first
    state[inside] = OTHER
    for k in range(1, DEPTH + 1):
        # A text's first bytes move on from its own start, not from the text before it.
        at = inside[inside + k < len(state)] + k
        state[at] = MOVES[(state[at - 1].astype(np.uint16) << 8) | seen[at - 1]]
        state[inside] = OTHER
    return MARKS[(state.astype(np.uint16) << 8) | seen][low - first :]


class Scan:
    """The marks of a buffer of texts, counted: per text (units, sentinels) and running per block (units, characters)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets.astype(np.int64)
        self.starts = np.unique(self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]])
        total = np.zeros((len(data) // BLOCK + 2, 2), np.int64)
        at = np.zeros((len(self.offsets), 2), np.int64)
        sentinels, base = np.zeros(len(self.offsets), np.int64), np.zeros(3, np.int64)
        for low in range(0, len(data), SLICE):
            high = min(low + SLICE, len(data))
            marked = marks(data, self.starts, low, high)
            flags = [(marked & bit) > 0 for bit in (UNIT, CHARACTER, SENTINEL)]
            running = [np.cumsum(f) for f in flags]
            here = slice(*np.searchsorted(self.offsets, [low + 1, high + 1]))
            for j in range(2):
                at[here, j] = base[j] + running[j][self.offsets[here] - low - 1]
            sentinels[here] = base[2] + running[2][self.offsets[here] - low - 1]
            blocks = np.arange(low // BLOCK + 1, (high - 1) // BLOCK + 2)
            ends = np.minimum(blocks * BLOCK, high) - low - 1
            for j in range(2):
                total[blocks, j] = base[j] + running[j][ends]
            base += [r[-1] for r in running]
        self.total, self.at = total, at
        self.units, self.sentinels = np.diff(at[:, 0]), np.diff(sentinels)

    def located(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the unit with this number (from 0; a text's count: its end) begins in each text: bytes of the buffer,
        and characters before it in its text."""
        place, characters = self.offsets[texts + 1].copy(), self.at[texts + 1, 1] - self.at[texts, 1]
        inner = np.flatnonzero(units < self.units[texts])
        rank = self.at[texts[inner], 0] + units[inner]
        block = np.searchsorted(self.total[:, 0], rank, "right") - 1
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
            b = block[part[0]]
            low, high = b * BLOCK, min((b + 1) * BLOCK, len(self.data))
            marked = marks(self.data, self.starts, low, high)
            found = np.flatnonzero(marked & UNIT)[rank[part] - self.total[b, 0]]
            before = np.cumsum((marked & CHARACTER) > 0)[found] - 1 + self.total[b, 1]
            place[inner[part]] = low + found
            characters[inner[part]] = before - self.at[texts[inner[part]], 1]
        return place, characters


def draws(doc_id: Column) -> Column:
    """Four numbers below 2^32 from an id: the first digits of the SHA-256 of ``1:`` and the decimal id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


NEW = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, plain: int = 10, spm: int = 20) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and output in place of text.

    The draws of a document's id choose both cuts and the form: of 100, ``plain`` stay as they are, of the others
    ``spm`` have the suffix first. A null text is empty; an empty one and one that holds a sentinel stay plain. Rows
    with one id and one text give the same; a null id draws as one without digits. Other columns pass through unless
    named as a new one, which then replaces it."""
    names = [c.split(" ")[0] for c in NEW.split(", ")]
    packed, unpacked = others(docs, *names)
    df = docs.select(packed, F.coalesce("text", F.lit("")).cast("binary").alias("data"), draws(F.col("doc_id")).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("data")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            held = column.buffers()[2]
            data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
            scan = Scan(data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))
            h = np.array(batch.column("draws").to_pylist(), np.int64).reshape(-1, 4)
            n = scan.units
            rows = np.arange(len(n))
            low, high = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
            whole = (n == 0) | (scan.sentinels > 0) | (h[:, 2] % 100 >= 100 - plain)
            first, second = h[:, 3] % 100 < spm, scan.located(rows, low)
            third = scan.located(rows, high)
            out, view = [], data.tobytes()
            for i in rows:
                a, d = scan.offsets[i], scan.offsets[i + 1]
                b, c = second[0][i], third[0][i]
                if whole[i]:
                    out.append(view[a:d])
                elif first[i]:
                    out.append(b"".join((SUFFIX, view[c:d], PREFIX, view[a:b], MIDDLE, view[b:c])))
                else:
                    out.append(b"".join((PREFIX, view[a:b], SUFFIX, view[c:d], MIDDLE, view[b:c])))
            form = np.where(whole, "plain", np.where(first, "spm", "psm"))
            cols = [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string())]
            cols += [pa.array(x, pa.int64(), mask=whole) for x in (second[1], third[1] - second[1])]
            yield pa.RecordBatch.from_arrays([batch.column("others"), *cols, pa.array(out, pa.binary()).cast(pa.string())], names=["others", *names])

    out = df.mapInArrow(run, f"others {df.schema['others'].dataType.simpleString()}, {NEW}")
    return out.select(*unpacked, *names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from: sentinels stand in it once each, so they part it."""
    parts = F.split(output, f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}")
    put = lambda *order: F.concat(*(F.get(parts, k) for k in order))
    return F.when(form == "psm", put(1, 3, 2)).when(form == "spm", put(2, 3, 1)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its units, form, lengths of prefix and middle, and digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id::varchar) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u,
  list_transform(range(0, 4), lambda k: list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(h, (8 * k + i)::int, 1)) - 1), lambda x, y: 16 * x + y)) as h from d),
c as (select *, len(u) as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain'
    when h[4] % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(u[1 : a], '') as p, array_to_string(u[a + 1 : b], '') as m, array_to_string(u[b + 1 : n], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
