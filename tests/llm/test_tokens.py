"""Token counts, pieces and packing against the public libraries and against brute force."""

import random


import numpy as np
import public_tokenizers as P

from tokenizers import Tokenizer

from convoke.llm import sentence_pieces, token_counts

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "tab\t\t x", "it's we're I'll 'S x' s", "naïve façade",
    "日本語 テキスト", "emoji 👩‍👩‍👧 done", "<|endoftext|>", "x  <|endoftext|>  y", "1234567 89.5%", " nb  sp", "　", "é" * 50,
    "▁marked ▁▁ text", "<s> </s> <unk> <0x0A>", "\x00nul", "line\r\nnext", "Σίσυφος ΣΑΣ", "aaaaaaaaaaaaaaaaaaaaaaaa", "hello" * 300, "-" * 200, " " * 40 + "x",
]


def texts(seed, n=300):
    rng = random.Random(seed)
    parts = ["the", "tion", " ", "  ", "\n", "é", "ing", "X", "9", ".", "'s", "ß", "–", "th", "un", "\t", "日", "or", "stan"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_counts_match_the_library():
    own = token_counts.PrefixCounter(P.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts(1):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert own.count(t, 10**9)[0] == n, t
        for limit in (1, 3, 10):
            got = own.count(t, limit)
            assert got[0] == n
            if n > limit and "<|" not in t:
                head = t.encode()[: got[1]]
                assert 0 <= got[1] < len(t.encode()) and own.prefixes(t)[got[1]] <= limit < own.prefixes(t)[-1], (t, head)


def test_every_prefix():
    own = token_counts.PrefixCounter(P.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for word in (" international", "antidisestablishment", " thonererthe", "éàü", "aaaaaaaaaa", " Sshthere"):
        counts = own.piece(word.encode())
        for i in range(1, len(word) + 1):
            head = word[:i]
            assert counts[len(head.encode())] == len(lib.encode(head, add_special_tokens=False).ids)


def test_pieces_match_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = sentence_pieces.Pieces(P.path("piece_bpe_32k.model"))
    every = texts(2)
    for t, ids in zip(every, own.encode(every), strict=True):
        got = np.frombuffer(ids, np.uint32)
        assert got.tolist() == lib.encode(t), t
        assert own.decode(got) == t.replace("▁", " "), t


def test_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "a b", None), (3, "word " * 30_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumnRenamed("n_tokens", "others")
    got = sorted(token_counts.token_counts(df).collect(), key=str)
    assert len(got) == 4 and {r.n_tokens for r in got if r.doc_id == 1} == {0}
    assert [r.over_limit for r in got if r.doc_id == 3] == [True]
    back = {r.doc_id: r.decoded for r in sentence_pieces.encoded(df).collect()}
    assert back == {1: "", None: "a b", 3: "word " * 30_000}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(empty).count() == 0 and sentence_pieces.encoded(empty).count() == 0


def test_merging_looks_at_the_pairs_beside_a_merge_only():
    """As many look-ups as characters, not their square, and the pieces of the plain way."""

    class Counted(dict):
        looked = 0

        def get(self, *args):
            Counted.looked += 1
            return super().get(*args)

    own = sentence_pieces.Pieces(P.path(sentence_pieces.VOCABULARY))
    own.score = Counted(own.score)
    assert own.merged("ab" * 300) and Counted.looked < 3 * 600
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("▁aeinorstlZé7") for _ in range(rng.randrange(1, 14)))
        parts = list(text)
        while any(a + b in own.score for a, b in sentence_pieces.pairwise(parts)):
            k = max((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in own.score), key=lambda k: (own.score[parts[k] + parts[k + 1]], -k))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert own.merged(text) == parts
    for raw in (b"a\nb\n\nc", bytes(range(128)), b"\xff\xfeab", b""):
        ids = np.array([own.id["▁"], *(own.bytes[b] for b in raw)], np.uint32)
        assert own.decode(ids) == raw.decode(errors="replace")
