"""NPY and TIFF bytes to arrays and back, with NumPy alone.

TIFF: baseline, one page for each z layer; strips or tiles, little or big
endian; integers and floats of 8 to 64 bits; uncompressed, PackBits or
deflate; one sample a pixel.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

# Tag numbers, field sizes and type letters of TIFF 6.0.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, PREDICTOR = 322, 323, 324, 325, 317
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def write_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def _expand(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 32773:
        return _unpack_bits(data)
    raise ValueError(f"TIFF compression {compression} is not supported")


def read_tiff(data: bytes) -> np.ndarray:
    """A (z, y, x) array, or (y, x) for a single page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags: dict[int, list] = {}
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind not in _TYPES or kind == 2:
                continue
            form = order + _TYPES[kind] * count
            size = struct.calcsize(form)
            raw = entry[8 : 8 + size] if size <= 4 else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + size]
            tags[tag] = list(struct.unpack(form, raw))
        pages.append(_page(data, order, tags))
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    if not pages:
        raise ValueError("a TIFF file without pages")
    return pages[0] if len(pages) == 1 else np.stack(pages)


def _page(data: bytes, order: str, tags: dict[int, list]) -> np.ndarray:
    w, h = tags[WIDTH][0], tags[LENGTH][0]
    if tags.get(SAMPLES, [1])[0] != 1:
        raise ValueError("only one sample a pixel is supported")
    dtype = np.dtype(f"{order}{_KINDS[tags.get(FORMAT, [1])[0]]}{tags.get(BITS, [1])[0] // 8}")
    how, differences = tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0] == 2
    undo = lambda a: np.cumsum(a, axis=1, dtype=a.dtype) if differences else a
    if TILE_OFFSETS in tags:
        tw, th = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]
        across = -(-w // tw)
        out = np.zeros((-(-h // th) * th, across * tw), dtype)
        for k, (o, c) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_COUNTS])):
            y, x = k // across * th, k % across * tw
            out[y : y + th, x : x + tw] = undo(np.frombuffer(_expand(data[o : o + c], how), dtype, tw * th).reshape(th, tw))
        return out[:h, :w].astype(dtype.newbyteorder("="))
    strips = [np.frombuffer(_expand(data[o : o + c], how), dtype) for o, c in zip(tags[OFFSETS], tags[COUNTS])]
    return undo(np.concatenate(strips)[: w * h].reshape(h, w).astype(dtype.newbyteorder("=")))


def write_tiff(array: np.ndarray) -> bytes:
    """Uncompressed, little-endian, a page and a strip for each layer."""
    a = array[None] if array.ndim == 2 else array
    if a.ndim != 3:
        raise ValueError("an array of two or three axes is needed")
    a = np.ascontiguousarray(a, a.dtype.newbyteorder("<"))
    kind = {v: k for k, v in _KINDS.items()}["u" if a.dtype.kind == "b" else a.dtype.kind]
    a = a.astype("<u1") if a.dtype.kind == "b" else a
    n, h, w = a.shape
    out = io.BytesIO()
    out.write(struct.pack("<2sHI", b"II", 42, 8))
    entries = 9
    size = 2 + 12 * entries + 4
    layer = h * w * a.itemsize
    pad = layer % 2
    for k in range(n):
        here = 8 + k * (size + layer + pad)
        strip = here + size
        tags = [(WIDTH, 4, w), (LENGTH, 4, h), (BITS, 3, a.itemsize * 8), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 4, strip), (ROWS, 4, h), (COUNTS, 4, layer), (FORMAT, 3, kind)]
        out.write(struct.pack("<H", entries))
        for tag, form, value in tags:
            out.write(struct.pack("<HHI", tag, form, 1) + (struct.pack("<HH", value, 0) if form == 3 else struct.pack("<I", value)))
        out.write(struct.pack("<I", here + size + layer + pad if k + 1 < n else 0))
        out.write(a[k].tobytes() + b"\0" * pad)
    return out.getvalue()


def read_array(name: str, data: bytes, first: str = "") -> np.ndarray:
    """By content: TIFF or NPY, whichever the bytes are; ``first`` (.tif or .npy) restricts it to one."""
    if data[:6] == b"\x93NUMPY" and first != ".tif":
        return read_npy(data)
    if data[:2] in (b"II", b"MM") and first != ".npy":
        return read_tiff(data)
    raise ValueError(f"{name}: neither NPY nor TIFF" if not first else f"{name}: not {first}")
