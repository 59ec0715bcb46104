"""Packing: whole, gapless and tight. Media: exact round trips and area means."""

import hashlib
import io
import struct
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from convoke.llm import media, packing

from .test_tokens import texts


def test_word_ids_match_the_library():
    own = packing.WordIds(P.path("word_bpe_49k.json"))
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    every = texts(6)
    for t, ids in zip(every, own.encode(every), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_word_ids_of_every_letter():
    """Every letter below U+20000, alone and in a word, with a full stop and a comma after it."""
    own = packing.WordIds(P.path("word_bpe_49k.json"))
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x20000)) if c.isalpha()]
    for form in ("{}.", "{},", "a{}.", "{}b,"):
        every = [form.format(c) for c in letters]
        want = lib.encode_batch_fast(every, add_special_tokens=False)
        assert [np.frombuffer(x, np.uint32).tolist() for x in own.encode(every)] == [w.ids for w in want]


def test_local_search_empties_bins():
    rng = np.random.default_rng(2)
    for _ in range(5):
        sizes = rng.integers(1, 2048, 700)
        start = packing.best_fit(sizes, 2048)
        end = packing.emptied(sizes, start, 2048)
        fill = np.bincount(end, sizes)
        assert fill.max() <= 2048 and len(np.unique(end)) <= len(np.unique(start))
        assert len(np.unique(end)) <= np.ceil(sizes.sum() / 2048) * 1.04 + 1
    loose = rng.integers(100, 600, 400)
    spread = np.arange(400) // 3
    assert len(np.unique(packing.emptied(loose, spread, 2048))) <= np.ceil(loose.sum() / 2048) * 1.3


def test_pack(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts(7))] + [(5000, "the cat sat " * 3000, 1), (5000, "the cat sat " * 3000, 1), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for lot in (packing.LOT, 60):
        got = packing.pack(df, lot=lot).collect()
        want = []
        for doc, text, _ in rows:
            ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
            for k, s in enumerate(range(0, len(ids), 2048)):
                part = np.array(ids[s : s + 2048], np.uint32)
                want.append(str((doc, k, s, len(part), zlib.crc32(part.tobytes()))))
        assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in got)
        assert len(by) <= total / 2048 * 1.1 + 3
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_formats():
    rng = np.random.default_rng(4)
    colour = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(colour)) == colour).all() and (media.decode(media.encode_ppm(colour)) == colour).all()
    grey = colour[..., :1]
    assert (media.decode(media.encode_ppm(grey)) == grey).all()
    plain = b"P3 # note\n5 7\n255\n" + b" ".join(str(x).encode() for x in colour.ravel())
    assert (media.decode(plain) == colour).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n")[..., 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))[..., 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5\n2 1\n65535\n\x01\x00\x00\x02")[..., 0].tolist() == [[256, 2]]


def test_area_means():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (12, 10, 3), dtype=np.uint8)
    assert np.allclose(media.resized(image, 12, 10), image) and np.allclose(media.resized(image, 1, 1)[0, 0], image.mean((0, 1)))
    assert np.allclose(media.resized(image, 6, 5), image.reshape(6, 2, 5, 2, 3).mean((1, 3)))
    fine = np.kron(image, np.ones((9, 8, 1)))
    assert np.allclose(media.resized(image, 9, 8), fine.reshape(9, 12, 8, 10, 3).mean((1, 3)))


def test_columns(spark):
    image = np.arange(30 * 40 * 3, dtype=np.int64).reshape(30, 40, 3).astype(np.uint8)
    df = spark.createDataFrame([(1, media.encode_bmp(image), 3), (2, None, 4)], "id int, image binary, row int")
    got = media.tiles(df, size=32, tile=16).collect()
    assert len(got) == 4 and {r.id for r in got} == {1} and np.load(io.BytesIO(got[0].npy)).shape == (16, 16, 3)
    rows = [(1, "a" * 576), (2, None), (3, ""), (4, "b" * 577)]
    by = {r.doc_id: r for r in media.text_images(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[1].payload_bytes == 576 and by[4].payload_bytes == 1152 and by[2].payload_sha256 == by[3].payload_sha256
    assert by[2].n_bytes == 0 and by[2].tail_crc32 == zlib.crc32(b"\xff" * 32)
    broken = spark.createDataFrame([(1, b""), (2, b"P6\n9 9\n255\nshort"), (3, b"BM"), (4, media.encode_ppm(image))], "id int, image binary")
    got = media.tiles(broken, size=32, tile=16).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 4, 4, 4] and all((r.npy is None) == (r.id < 4) for r in got)
    assert media.text_images(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_images_by_brute_force(spark):
    """Every column computed anew: headers by hand, hashes and area means by plain loops."""
    rows = [(i, t) for i, t in enumerate(texts(9)[:60])] + [(100, None), (101, "x" * 577)]

    def means(image, height, width):
        h, w, c = image.shape
        fine = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)
        return fine.reshape(height, h, width, w, c).mean((1, 3))

    def dhash(image):
        grey = np.rint(means(image, 8, 9).mean(axis=2) * 1024)
        bits = "".join("1" if grey[r, c] > grey[r, c + 1] else "0" for r in range(8) for c in range(8))
        return f"{int(bits, 2):016x}"

    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in media.text_images(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        image = np.frombuffer(payload, np.uint8).reshape(-1, 192, 3)
        ppm = b"P6\n192 %d\n255\n" % len(image) + payload
        bmp = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(payload), 0, 0, 54, 40, 192, len(image), 1, 24, 0, len(payload), 2835, 2835, 0, 0)
        bmp += b"".join(bytes(row[:, ::-1].ravel()) for row in image[::-1])
        small = np.rint(means(image, 32, 32)).astype(np.uint8)
        cut = [small[r : r + 16, c : c + 16] for r in (0, 16) for c in (0, 16)]
        out = io.BytesIO()
        for x in cut:
            np.save(out, x)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.bmp_payload_sha256) == (len(data), len(payload), sha(payload), sha(payload))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256, r.bmp_sha256) == (zlib.crc32(payload[-32:]), len(ppm), sha(ppm), sha(bmp))
        assert (r.feature, r.tiles_sha256, r.tile_hashes) == (dhash(image), sha(out.getvalue()), " ".join(map(dhash, cut))), doc
