"""Media columns: Netpbm and BMP to numpy arrays, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import doc_text, slices

WIDTH, BLOCK = 64, 192
_PNM = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?")


def decode_pnm(data: bytes) -> np.ndarray:
    """P1 to P6 as ``uint8`` (or ``uint16`` for a maximum above 255), height x width (x 3).

    Bits become 0 (black, written 1) and 255. Raises ValueError for anything else or for missing samples.
    """
    m = _PNM.match(data)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, w, h = int(m[1]), int(m[2]), int(m[3])
    if kind in (1, 4):
        at = m.end(3)
        if kind == 4:
            row = -(-w // 8)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        else:
            bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[: w * h].reshape(h, w) - 48
        return ((1 - bits) * 255).astype(np.uint8)
    if not m[4] or not 0 < int(m[4]) < 65536:
        raise ValueError("bad maximum in a Netpbm image")
    shape, wide = (h, w, 3) if kind in (3, 6) else (h, w), int(m[4]) > 255
    n = int(np.prod(shape))
    if kind in (2, 3):
        return np.array(re.sub(rb"#[^\n]*", b"", data[m.end() :]).split()[:n], np.uint16 if wide else np.uint8).reshape(shape)
    out = np.frombuffer(data, ">u2" if wide else np.uint8, n, m.end() + 1).reshape(shape)
    return out.astype(np.uint16) if wide else out


def encode_pnm(image: np.ndarray) -> bytes:
    """P6 for height x width x 3, P5 for height x width; 8-bit samples."""
    h, w = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8 (palette), 24 or 32 bits as ``uint8``, height x width x 3 in RGB order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP is not supported")
    row = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        image = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[rows][..., 2::-1]
    else:
        image = rows.reshape(abs(h), w, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(image[::-1] if h > 0 else image)


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP of height x width x 3."""
    h, w = image.shape[:2]
    row = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, row), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + row * h, 0, 0, 54, 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_pnm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's exact area, from an integral image; float64."""
    flat = image.reshape(image.shape[0], image.shape[1], -1).astype(np.float64)
    h, w, c = flat.shape
    total = np.zeros((h + 1, w + 1, c))
    total[1:, 1:] = flat.cumsum(0).cumsum(1)

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(m + 1) * (n / m)
        low = np.minimum(x.astype(np.int64), n - 1)
        return low, x - low

    (y, fy), (x, fx) = edges(h, height), edges(w, width)
    rows = total[y] * (1 - fy)[:, None, None] + total[y + 1] * fy[:, None, None]
    cells = rows[:, x] * (1 - fx)[None, :, None] + rows[:, x + 1] * fx[None, :, None]
    sums = cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]
    out = sums / ((h / height) * (w / width))
    return out.reshape(height, width) if image.ndim == 2 else out


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, side: int = 8) -> int:
    """One bit for each of side x side neighbours: is the right one brighter?"""
    small = np.round(area_resize(gray(image), side, side + 1), 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """The image area-resized to side x side, as the bytes of an NPY file of ``uint8``."""
    tile = np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def payload_image(payload: bytes) -> np.ndarray:
    """Bytes as RGB samples, 64 pixels a row, after spaces up to a positive multiple of 192."""
    padded = payload + b" " * (-len(payload) % BLOCK if payload else BLOCK)
    return np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3)


IMAGES = "doc_id long, n_bytes long, media binary"


def text_images(docs: DataFrame, form: str = "pnm") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text's bytes as an image, Netpbm or (``bmp``) BMP.

    Null and empty texts give one row of spaces. Other columns are ignored; repeated rows repeat; no rows give
    none.
    """
    encode = {"pnm": encode_pnm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            media = [encode(payload_image(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return doc_text(docs).mapInArrow(run, IMAGES)


TILES = "doc_id long, tile binary, dhash string"


def media_tiles(images: DataFrame) -> DataFrame:
    """``doc_id, tile, dhash`` of each stored image: its NPY tile and its difference hash in hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            seen = [decode(media) for media in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(npy_tile, seen), pa.binary()), pa.array([f"{difference_hash(x):016x}" for x in seen], pa.string())], names=["doc_id", "tile", "dhash"])

    return images.select("doc_id", "media").mapInArrow(run, TILES)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(images: DataFrame) -> DataFrame:
    """What ``text_images`` stored, read back: the samples' digests and a feature of their hash and tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            ids, sizes, medias = (b.column(i) for i in range(3))
            out = []
            for media in medias.to_pylist():
                image = decode(media)
                payload = image.tobytes()
                feature = f"{difference_hash(image):016x}:{zlib.crc32(npy_tile(image)):08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return images.mapInArrow(run, DIGEST)
