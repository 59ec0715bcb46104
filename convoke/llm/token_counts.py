"""Token counts: the exact number of BPE tokens of every prefix of a text, by dynamic programming.

The encoding of a prefix ends in exactly one token that may stand after the encoding of what precedes it, so

    count[i] = count[i - len(t)] + 1,   t the token that ends at i and is compatible with the last token before it,

gives the counts of all prefixes in one pass. Truncation and budget questions ("how much of it fits in n tokens?") are
then look-ups. Merges never cross the pieces that the pre-tokenizer cuts, so the programme runs once for each distinct
chunk of text between two plain spaces, and documents add up the counts of their chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, others, table

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Distinct chunks that a worker remembers; it forgets them all beyond that.
REMEMBERED = 1_000_000
#: A plain space between two characters that aren't white space: the pre-tokenizer always cuts before it.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes, for the byte-level BPE in a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = [t["content"] for t in model["added_tokens"]]
        vocab = {k: v for k, v in model["model"]["vocab"].items() if k not in special}
        self.id = {raw(k): v for k, v in vocab.items()}
        self.merge, self.parts = {}, {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((left, right), rank)
            self.parts.setdefault(whole, (left, right, rank))
        self.longest = max(map(len, self.id))
        self.special = special
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, int] = {}
        # Tokens that BPE never gives for their own bytes can't end an encoding.
        self.id = {k: v for k, v in self.id.items() if v in self.parts or len(k) == 1}

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at the token's left (0) or right (1) edge as it was merged, each with the rank that ended it."""
        known = self.spines[side]
        if token not in known:
            out, now, until = [], token, float("inf")
            while True:
                out.append((now, until))
                if now not in self.parts:
                    break
                left, right, until = self.parts[now]
                now = right if side else left
            known[token] = out
        return known[token]

    def compatible(self, a: int, b: int) -> bool:
        """Does BPE leave token a before token b? Not if tokens at the edge would have been merged across it first.

        Of merges with one rank the leftmost goes first: one inside a before, one inside b after that across."""
        found = self.fits.get((a, b))
        if found is None:
            found = True
            right = self.spine(b, 0)
            for u, until_u in self.spine(a, 1):
                for v, until_v in right:
                    rank = self.merge.get((u, v))
                    if rank is not None and rank < until_u and rank <= until_v:
                        found = False
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        """Tokens of each prefix (of 0, 1, .. bytes) of what the pre-tokenizer leaves whole."""
        last, count, ids = [-1] * (len(data) + 1), [0] * (len(data) + 1), self.id
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - self.longest), i):
                t = ids.get(data[j:i])
                if t is not None and (j == 0 or self.compatible(last[j], t)):
                    last[i], count[i] = t, count[j] + 1
                    break
        return count

    def prefixes(self, text: str) -> list[int]:
        """Tokens of the pieces of the text up to each byte; at ends of pieces also what the library counts for the prefix."""
        out = [0]
        for word in self.pattern.findall(text):
            out += [out[-1] + n for n in self.piece(word.encode())[1:]]
        return out

    def chunk(self, text: str) -> int:
        found = self.chunks.get(text)
        if found is None:
            found = sum(self.piece(w.encode())[-1] for w in self.pattern.findall(text))
            if len(self.chunks) > REMEMBERED:
                self.chunks.clear()
            self.chunks[text] = found
        return found

    def chunk_list(self, text: str) -> list[str]:
        first, *rest = CUT.split(text)
        return [first, *[" " + x for x in rest]]

    def count(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and bytes of the longest prefix that ends with a token and stays within the limit."""
        if any(s in text for s in self.special):
            n = len(self.library.encode(text, add_special_tokens=False).ids)
            return n, (len(text.encode()) if n <= limit else -1)
        chunks = self.chunk_list(text)
        known = self.chunks
        counts = [known[x] if x in known else self.chunk(x) for x in chunks]
        total = sum(counts)
        if total <= limit:
            return total, len(text.encode())
        used, at = 0, 0
        while used + counts[at] <= limit:
            used += counts[at]
            at += 1
        inside = self.prefixes(chunks[at])
        fits = max(i for i, n in enumerate(inside) if used + n <= limit)
        return total, len("".join(chunks[:at]).encode()) + fits


def token_counts(documents: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with n_bytes, n_tokens, over_limit and fit_bytes in place of text; one row for each.

    fit_bytes: bytes of the longest prefix whose pieces have limit tokens at most (-1 for a text beyond the limit with
    a special token in it, which the library counts as one). A null or empty text has no tokens. Other columns pass
    through unless named as one of the new ones, which then replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(vocabulary)
        own = held((PrefixCounter, path), lambda: PrefixCounter(path))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [own.count(t, limit) for t in texts]
            size = [len(t.encode()) for t in texts]
            cols = [pa.array(size, pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([n > limit for n, _ in found]), pa.array([b for _, b in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("others"), *cols], names=["others", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    held_too, back = others(documents, "n_bytes", "n_tokens", "over_limit", "fit_bytes")
    df = documents.select(held_too, F.coalesce("text", F.lit("")).alias("text"))
    schema = f"others {df.schema['others'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long"
    return df.mapInArrow(run, schema).select(*back, "n_bytes", "n_tokens", "over_limit", "fit_bytes")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens, whether it is over 512 tokens, and how much of it fits."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
