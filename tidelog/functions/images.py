"""8-bit images as PNG bytes, by the published format: header, one deflated stream of filtered rows, end. Colour types 0 (grey) and 2 (RGB)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    """(height, width) or (height, width, 3), unsigned bytes."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or (image.ndim == 3 and image.shape[2] != 3):
        raise ValueError(f"an image is (h, w) or (h, w, 3) bytes, not {image.shape} {image.dtype}")
    rows = image.reshape(image.shape[0], -1)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(raw)) + _part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, parts = 8, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"{kind.decode('latin-1')} is damaged")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or colour not in (0, 2) or interlaced:
        raise ValueError("only plain 8-bit grey and RGB images are read")
    step = 3 if colour == 2 else 1
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, step + width * step), np.int64)  # a row above and a pixel to the left are zero
    for y, (how, *row) in enumerate(lines.tolist(), 1):
        above, own = out[y - 1], out[y]
        if how in (0, 2):
            own[step:] = (np.array(row) + (above[step:] if how == 2 else 0)) % 256
            continue
        for x, value in enumerate(row, step):
            left, up, corner = int(own[x - step]), int(above[x]), int(above[x - step])
            if how == 1:
                value += left
            elif how == 3:
                value += (left + up) // 2
            elif how == 4:
                value += min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            else:
                raise ValueError(f"row filter {how}")
            own[x] = value % 256
    image = out[1:, step:].astype(np.uint8).reshape(height, width, step)
    return image if step == 3 else image[:, :, 0]


def images_table(images: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> pa.Table:
    """item_id, label and image, the bytes of a PNG."""
    return pa.table({"item_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64()), "image": pa.array([encode_png(x) for x in images], pa.binary())})


def decode_column(table: pa.Table, column: str = "image") -> np.ndarray:
    return np.stack([decode_png(x.as_py()) for x in table.column(column)])
