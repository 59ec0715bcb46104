"""Best-fit packing: documents into sequences of a fixed number of tokens, improved by swaps between sequences.

Documents are tokenised (each distinct word once a worker) and cut only where longer than a sequence. Pieces are dealt
into lots of about ``LOT`` by a hash; each lot is packed best-fit decreasing, and the sequences that stay underfull are
then emptied one after the other by local search: a document moves to a sequence with room for it, or one or two
documents change places with a smaller one of a fuller sequence. Every step makes the sum of squared fills larger, so
the search ends. What is still underfull in its lot is dealt into lots again with that of all others, and packed anew.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, keyed, table, written

VOCABULARY, SEQUENCE, END = "word_bpe_49k.json", 2048, 0
#: Signs that end many words.
SIGNS = (".", ",")
#: Words of letters that the library keeps whole when it normalises them (Latin ones but for the dotted capital I, whose
#: lower case is two characters), and how many of them it gets at once.
PLAIN, TOGETHER = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch, 200
#: Pieces that one task packs together, about.
LOT = 50_000
#: Distinct words that a worker remembers; it forgets them all beyond that.
REMEMBERED = 1_200_000


class WordIds:
    """Ids of texts by a tokenizers file whose pre-tokenizer drops white space, so that words can be looked up."""

    def __init__(self, path: str):
        # Threads of its own would only wait beside the other tasks, and cost time while they do.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.parted: dict[str, bool] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {"": b""}
            new = {w for words in split for w in words} - {""}
        self.learn(new)
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def learn(self, new: set[str]) -> None:
        """Ids of new words. The tokenizer lower-cases and cuts signs off letters, so most words share a plainer one's."""
        self.look_at({w[-2] for w in new if w[-1:] in SIGNS and w[-2:-1].isalpha()} - self.parted.keys())
        plain = {w: self.parts(w) for w in new}
        cores = list({core for core, _ in plain.values()}.union(SIGNS).difference(self.words))
        self.words.update(zip(cores, self.ids(cores), strict=True))
        words = self.words
        for word, (core, sign) in plain.items():
            words[word] = words[core] + words[sign] if sign else words[core]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Plain words go to the library many in a text, as its tokens tell which word they are of."""
        plain = [k for k, x in enumerate(texts) if PLAIN(x)]
        out: list[bytes] = [b""] * len(texts)
        rest = [k for k, x in enumerate(texts) if not PLAIN(x)]
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for group, found in zip(groups, self.library.encode_batch([" ".join(texts[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            ids, word = array("I", found.ids).tobytes(), np.array(found.word_ids)
            cuts = np.flatnonzero(np.diff(word, prepend=-1)).tolist()
            if len(cuts) != len(group):
                rest += group
                continue
            for k, low, high in zip(group, cuts, [*cuts[1:], len(word)], strict=True):
                out[k] = ids[4 * low : 4 * high]
        for k, found in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = array("I", found.ids).tobytes()
        return out

    def look_at(self, letters: set[str]) -> None:
        """Which letters are cut from a sign after them: those of some scripts are taken apart when the library normalises
        a word, so that the sign follows a mark and stays with it."""
        letters = sorted(letters)
        forms = [before + c for c in letters for before in ("", "a")]
        every = self.ids([*SIGNS, *forms, *(f + sign for f in forms for sign in SIGNS)])
        signs, alone, signed = every[: len(SIGNS)], every[len(SIGNS) : len(SIGNS) + len(forms)], every[len(SIGNS) + len(forms) :]
        same = [all(signed[k * len(SIGNS) + j] == x + y for j, y in enumerate(signs)) for k, x in enumerate(alone)]
        self.parted |= {c: same[2 * k] and same[2 * k + 1] for k, c in enumerate(letters)}

    def parts(self, word: str) -> tuple[str, str]:
        """A word with the same ids in lower case (where that is plain), and the full stop or comma after its letters, if
        it is cut off there."""
        sign = word[-1] if word[-1] in SIGNS and self.parted.get(word[-2:-1], False) else ""
        core = word[: len(word) - len(sign)]
        return (core.lower() if core.isascii() and "<|" not in core or PLAIN(core) else core), sign


def pieces(documents: DataFrame, sequence: int = SEQUENCE, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece: others (all columns but text), doc, rid, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(vocabulary)
        own = held((WordIds, path), lambda: WordIds(path))
        close = end.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, start, length, crc = [], [], [], []
                for i, ids in enumerate(own.encode(part.column("text").to_pylist())):
                    ids += close
                    for s in range(0, len(ids), 4 * sequence):
                        piece = ids[s : s + 4 * sequence]
                        row.append(i)
                        start.append(s // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                start = np.array(start, np.int64)
                cols = [part.column(k).take(pa.array(row, pa.int64())) for k in ("doc", "rid", "others")]
                cols += [pa.array((start // sequence).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "rid", "others", "piece", "start", "length", "ids_crc32"])

    df = keyed(documents, F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")).alias("others"))
    kind = df.schema["others"].dataType.simpleString()
    return df.mapInArrow(run, f"doc long, rid int, others {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, room: int) -> np.ndarray:
    """Bins of the sizes, packed in decreasing order, each into the fullest bin that takes it."""
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    open_gaps = np.zeros(room + 1, bool)
    out, n = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        gap = size + int(np.argmax(open_gaps[size:]))
        if open_gaps[gap]:
            k = by_gap[gap].pop()
            open_gaps[gap] = bool(by_gap[gap])
        else:
            k, gap, n = n, room, n + 1
        out[i] = k
        by_gap[gap - size].append(k)
        open_gaps[gap - size] = True
    return out


def emptied(sizes: np.ndarray, bins: np.ndarray, room: int) -> np.ndarray:
    """bins, after local search has emptied as many as it can.

    Taken emptiest first, as many as exceed the least possible number, and twice over: each of a bin's documents moves
    to the fullest bin with room, or it (or two of them) changes places with a smaller document of a fuller bin, the
    exchange that fills that bin most. Only steps that increase the sum of squared fills are taken."""
    bins = bins.copy()
    fill = np.bincount(bins, sizes).astype(np.int64)
    members = [set() for _ in fill]
    for i, k in enumerate(bins.tolist()):
        members[k].add(i)
    least = -(-int(sizes.sum()) // room)
    surplus = int((fill > 0).sum()) - least
    if surplus <= 0:
        return bins
    loose = np.flatnonzero(fill[bins] < room)  # documents that a step can change places with

    def put(i: int, k: int) -> None:
        old = int(bins[i])
        members[old].remove(i)
        members[k].add(i)
        fill[old] -= sizes[i]
        fill[k] += sizes[i]
        bins[i] = k

    def step(a: int) -> bool:
        docs = sorted(members[a], key=lambda i: -sizes[i])
        for i in docs:
            gap = room - fill
            fits = np.flatnonzero((gap >= sizes[i]) & (fill + sizes[i] > fill[a]) & (fill > 0))
            fits = fits[fits != a]
            if len(fits):
                put(i, int(fits[np.argmax(fill[fits])]))
                return True
        home = bins[loose]
        usable = (home != a) & (fill[home] >= fill[a])
        small, gap = sizes[loose], (room - fill)[home]
        groups = [(i,) for i in docs] + [(docs[x], docs[y]) for x in range(len(docs)) for y in range(x)]
        for group in groups:
            gain = sum(int(sizes[i]) for i in group) - small
            good = np.where(usable & (gain > 0) & (gain <= gap), gain, 0)
            best = int(np.argmax(good))
            if good[best] > 0:
                j, k = int(loose[best]), int(home[best])
                for i in group:
                    put(i, k)
                put(j, a)
                return True
        return False

    for _ in range(2):
        for a in np.argsort(np.where(fill > 0, fill, room + 1), kind="stable")[: 2 * surplus].tolist():
            while members[a] and step(a):
                pass
        surplus = int((fill > 0).sum()) - least
        if surplus <= 0:
            break
    return bins


def _pack(room: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc", "rid", "piece"], ascending=False, kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins = emptied(sizes, best_fit(sizes, room), room)
        bins = np.unique(bins, return_inverse=True)[1].reshape(-1)
        order = np.argsort(bins, kind="stable")
        pdf, bins, sizes = pdf.iloc[order], bins[order], sizes[order]
        fill = np.bincount(bins, sizes).astype(np.int64)
        before = np.cumsum(sizes) - sizes
        first = np.concatenate(([0], np.cumsum(fill)[:-1]))
        return pdf.assign(number=bins.astype(np.int64), offset=before - first[bins], fill=fill[bins])

    return run


def pack(documents: DataFrame, sequence: int = SEQUENCE, end: int = END, vocabulary: str = VOCABULARY, lot: int = LOT) -> DataFrame:
    """Pieces placed in sequences: the columns of documents but text, then piece, start, length, ids_crc32,
    sequence_id and offset.

    Every document ends with the id ``end``, so a null or empty text is a piece of one token. Rows that repeat a
    doc_id are separate documents. Other columns pass through unless named as one of the new ones, which then replaces
    it; an empty table gives an empty one."""
    # uid: tells the pieces of repeated rows apart; written down, so that all uses of it agree.
    whole = written(pieces(documents, sequence, end, vocabulary).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    # The top bit is set in the ids of full pieces and free in those of lots.
    full = whole.where(F.col("length") == sequence).withColumns({"sequence_id": F.col("uid").bitwiseOR(F.lit(-(2**63))), "offset": F.lit(0).cast("long")})
    rest = whole.where(F.col("length") < sequence)
    schema = "doc long, rid int, piece int, length long, uid long, lot long, number long, offset long, fill long"

    def dealt(df: DataFrame, seed: int, n: int) -> DataFrame:
        lots = max(1, -(-n // lot))
        df = df.select("doc", "rid", "piece", "length", "uid", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(lots)).alias("lot"))
        return written(df.groupBy("lot").applyInPandas(_pack(sequence), schema), "packed")

    n = rest.count()
    one = dealt(rest, 1, n)
    if n > lot:
        under = one.where(F.col("fill") < sequence)
        two = dealt(under, 2, under.count())
        done = one.where(F.col("fill") == sequence).withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))
    else:
        done = one.withColumn("round", F.lit(1))
    number = F.shiftleft(F.col("round").cast("long"), 61).bitwiseOR(F.shiftleft("lot", 32)).bitwiseOR(F.col("number"))
    placed = rest.join(done.select("uid", number.alias("sequence_id"), "offset"), "uid")
    every = full.unionByName(placed.select(full.columns))
    new = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = [F.col(f"others.`{c}`") for c in documents.columns if c != "text" and c.lower() not in new]
    return every.select(*kept, *new)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its document, ids and place."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
