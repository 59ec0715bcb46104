"""Media columns: Netpbm and BMP images, area-resized, cut into NPY tiles with difference hashes.

Images come as binary columns and are decoded to numpy arrays by the formats' headers; resizing averages areas by
integral images (a summed-area table read at fractional corners), so its cost follows the source's pixels whatever the
target; tiles are written in the NPY format. The difference hash compares neighbours of the area-resized grey image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes in a row of a payload image: 192 pixels of three samples.
ROW = 576


def netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header after its magic, skipping comments, and where the samples begin."""
    out, at = [], 2
    while len(out) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = (data.index(b"\n", at) if data[at : at + 1] == b"#" else at) + 1
        begin = at
        while data[at : at + 1].isdigit():
            at += 1
        out.append(int(data[begin:at]))
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width x channels of 8-bit or 16-bit samples (bitmaps: 0 for black, 255 for white)."""
    kind = int(data[1:2])
    (width, height, *rest), at = netpbm_header(data, 2 if kind in (1, 4) else 3)
    channels, top = (3 if kind in (3, 6) else 1), (rest or [1])[0]
    n = width * height * channels
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * -(-width // 8), at).reshape(height, -1), axis=1)
        return (255 * (1 - bits[:, :width])).astype(np.uint8)[..., None]
    if kind == 1:
        return (255 * (1 - np.array([int(c) for c in data[at - 1 :].decode() if c in "01"][:n], np.uint8))).reshape(height, width, 1)
    if kind in (2, 3):
        samples = np.array(data[at - 1 :].split()[:n], dtype=np.int64)
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
    return samples.reshape(height, width, channels).astype(np.uint8 if top < 256 else np.uint16)


def encode_ppm(image: np.ndarray) -> bytes:
    """P6 (three channels) or P5 (one) of 8-bit samples."""
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + np.ascontiguousarray(image).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (with palette), 24 or 32 bits a pixel as height x width x 3, in red, green, blue."""
    at, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packing}: not supported")
    stride, rows = -(-width * bits // 32) * 4, abs(height)
    flat = np.frombuffer(data, np.uint8, stride * rows, at).reshape(rows, stride)
    flat = flat[::-1] if height > 0 else flat
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, -1, 14 + size)[: at - 14 - size].reshape(-1, 4)[:, 2::-1]
        return palette[flat[:, :width]]
    return flat[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP, rows from the bottom."""
    height, width, _ = image.shape
    stride = -(-width * 3 // 4) * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the target's pixels cover, as floats: an integral image read at fractional corners."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(image, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def read(at: np.ndarray, axis: int, n: int, x: np.ndarray) -> np.ndarray:
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        return np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part

    rows = read(np.arange(height + 1) * (h / height), 0, h, total)
    both = read(np.arange(width + 1) * (w / width), 1, w, rows)
    return np.diff(np.diff(both, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: is each of 8 x 9 area means of the grey image, rounded to 1/1024, above its right neighbour?"""
    grey = np.rint(resized(image, 8, 9).mean(axis=2) * 1024)
    return np.packbits(grey[:, :-1] > grey[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def tiled(image: np.ndarray, size: int, tile: int) -> list[tuple[int, int, bytes, str]]:
    """Row, column, NPY bytes and difference hash of each tile of an image area-resized to size x size."""
    if not image.size:
        raise ValueError("an image without pixels")
    image = np.clip(np.rint(resized(image, size, size)), 0, 255).astype(np.uint8)
    cut = [(r // tile, c // tile, image[r : r + tile, c : c + tile]) for r in range(0, size, tile) for c in range(0, size, tile)]
    return [(r, c, npy(x), difference_hash(x)) for r, c, x in cut]


def tiles(images: DataFrame, column: str = "image", size: int = 224, tile: int = 112) -> DataFrame:
    """A row for each tile: the other columns, row, col, npy (binary, tile x tile x channels of 8-bit samples), dhash.

    Images are area-resized to size x size first. A null image has no tiles; one that can't be decoded has one row with
    null in the new columns. Other columns pass through unless they are named as a new one, which then replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("image").to_pylist()):
                if data is None:
                    continue
                try:
                    cut = tiled(decode(data), size, tile)
                except (ValueError, IndexError, struct.error, ZeroDivisionError):
                    cut = [(None,) * 4]
                cols = [pa.array(x, kind) for x, kind in zip(zip(*cut, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                others = batch.column("others").take(pa.array([i] * len(cut)))
                yield pa.RecordBatch.from_arrays([others, *cols], names=["others", "row", "col", "npy", "dhash"])

    new = ["row", "col", "npy", "dhash"]
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in images.columns if c != column and c.lower() not in new)).alias("others")
    df = images.select(others, F.col(f"`{column}`").alias("image"))
    out = df.mapInArrow(run, f"others {df.schema['others'].dataType.simpleString()}, row int, col int, npy binary, dhash string")
    return out.select("others.*", *new).drop("_")


def payload_image(payload: bytes) -> bytes:
    """Some bytes, padded with 255 to a positive multiple of 576, as a P6 image 192 pixels wide."""
    rows = max(1, -(-len(payload) // ROW))
    padded = payload + b"\xff" * (rows * ROW - len(payload))
    return encode_ppm(np.frombuffer(padded, np.uint8).reshape(rows, ROW // 3, 3))


def text_images(documents: DataFrame, size: int = 32, tile: int = 16) -> DataFrame:
    """documents with their text stored as an image and read back: n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256 and feature (the difference hash) in place of text; then bmp_sha256 (the same image
    as BMP), bmp_payload_sha256 (what that holds when read back), and of the NPY tiles of the image area-resized to size x
    size, row by row, tiles_sha256 (their bytes) and tile_hashes (their difference hashes, joined by spaces).

    A null or empty text is one row of padding. Equal texts give equal values. Other columns pass through unless named
    as one of the new ones, which then replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("data").to_pylist():
                media = payload_image(data)
                image = decode(media)
                back = np.ascontiguousarray(image).tobytes()
                bmp = encode_bmp(image)
                cut = tiled(decode(bmp), size, tile)
                sha = lambda *parts: hashlib.sha256(b"".join(parts)).hexdigest()
                row = (len(data), len(back), sha(back), zlib.crc32(back[-32:]), len(media), sha(media), difference_hash(image))
                out.append((*row, sha(bmp), sha(np.ascontiguousarray(decode(bmp)).tobytes()), sha(*(x[2] for x in cut)), " ".join(x[3] for x in cut)))
            cols = [pa.array(x) for x in zip(*out, strict=True)] if out else [pa.array([], f.type) for f in batch.schema][:0]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("others"), *cols], names=["others", *new])

    new = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bmp_sha256", "bmp_payload_sha256", "tiles_sha256", "tile_hashes"]
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in documents.columns if c != "text" and c.lower() not in new)).alias("others")
    df = documents.select(others, F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    kind = df.schema["others"].dataType.simpleString()
    out = df.mapInArrow(run, f"others {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bmp_sha256 string, bmp_payload_sha256 string, tiles_sha256 string, tile_hashes string")
    return out.select("others.*", *new).drop("_")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text's bytes as an image, read back, with digests and hashes of its forms and tiles."""
    return text_images(table(spark, sf_dir, "documents").select("doc_id", "text"))
