"""SentencePiece encoding and decoding by a forward pass over a trie of the distinct words.

Distinct words, marked with the space sign before them, are sorted, which lays their trie out depth-first: a word
shares the forward states of its common prefix with the word before it and only goes on from there. The public model
is a BPE model, whose encoding isn't the best sum of scores but the one its merges leave; the forward state at a
prefix is therefore the one piece that may end the encoding of that prefix (it must not merge with the piece before
it), in place of the best-scoring one that a unigram model would keep. Words then look up their pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, others, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 700_000
#: No piece goes on with the space sign after another character: the text can be cut there.
CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class Pieces:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes, self.id, self.score, self.text = {}, {}, {}, [""] * n
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[name], self.score[name], self.text[i] = i, model.get_score(i), name
        self.value = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.value)] = True
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        # Pieces that merging their own characters doesn't give can't end an encoding.
        self.whole = {p: i.to_bytes(4, "little") for p, i in self.id.items() if len(p) == 1 or self.merged(p) == [p]}
        # The longest such piece that ends with some three characters.
        self.longest: dict[str, int] = {}
        for p in self.whole:
            if len(p) > 2:
                self.longest[p[-3:]] = max(len(p), self.longest.get(p[-3:], 0))

    def merged(self, text: str) -> list[str]:
        """Pieces left when the best-scoring neighbours (of equals the leftmost) are merged until none is a piece.

        A merge changes the scores of the pairs beside it only."""
        parts, score, none = list(text), self.score.get, -math.inf
        scores = [score(a + b, none) for a, b in pairwise(parts)]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def forward(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words, sorted, with their ids: depth-first over their trie, one state for each character of the path."""
        before, ends, ids = "", [""], [b""]
        whole, longest, fits = self.whole.get, self.longest.get, self.fits.get
        for word in words:
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del ends[k + 1 :], ids[k + 1 :]
            for i in range(k + 1, len(word) + 1):
                for j in range(max(0, i - longest(word[i - 3 : i], 2)) if i > 2 else 0, i):
                    p = word[j:i]
                    code = whole(p)
                    if code is None:
                        continue
                    fit = True if j == 0 else fits((ends[j], p))
                    if self.compatible(ends[j], p) if fit is None else fit:
                        ends.append(p)
                        ids.append(ids[j] + code)
                        break
                else:  # a character that the vocabulary lacks: its bytes
                    p = word[i - 1]
                    ends.append(p)
                    ids.append(ids[i - 1] + b"".join(self.bytes[b].to_bytes(4, "little") for b in p.encode()))
            before = word
            yield word, ids[-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        marked = [CUT.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {w for words in marked for w in words} - self.words.keys()
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = {w for words in marked for w in words}
        self.words.update(self.forward(sorted(new)))
        return [b"".join(map(self.words.__getitem__, words)) for words in marked]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that aren't UTF-8 become replacement characters."""
        of = self.text.__getitem__
        is_byte = self.is_byte[ids]
        if is_byte.any():
            # Runs of bytes and of other pieces take turns.
            cuts = np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1
            borders, each, run = [0, *cuts.tolist(), len(ids)], ids.tolist(), bool(is_byte[0])
            parts = []
            for low, high in pairwise(borders):
                part = each[low:high]
                parts.append(bytes(map(self.value.__getitem__, part)).decode(errors="replace") if run else "".join(map(of, part)))
                run = not run
            text = "".join(parts)
        else:
            text = "".join(map(of, ids.tolist()))
        return text.replace(MARK, " ")[1:]


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with ids (binary, little-endian 32-bit) and decoded (the text that they give back) in place of text.

    A null or empty text has no ids. A space sign in a text is decoded as a space. Other columns pass through unless
    named as one of the new ones, which then replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(vocabulary)
        own = held((Pieces, path), lambda: Pieces(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = own.encode(part.column("text").to_pylist())
                back = [own.decode(np.frombuffer(x, np.uint32)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("others"), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["others", "ids", "decoded"])

    held_too, back = others(documents, "ids", "decoded")
    df = documents.select(held_too, F.coalesce("text", F.lit("")).alias("text"))
    schema = f"others {df.schema['others'].dataType.simpleString()}, ids binary, decoded string"
    return df.mapInArrow(run, schema).select(*back, "ids", "decoded")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, the ids' checksum and digest, and the digest of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.length(F.encode("decoded", "UTF-8")).cast("long").alias("n_bytes"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
