"""PNG decoding and encoding: 8-bit grey, grey with alpha, RGB, palette and RGBA, without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # colour type -> values a pixel


class BadImage(ValueError):
    """Not an image that this decoder reads."""


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """(height x width x 4 array, whether the file has alpha)."""
    if data[:8] != SIGNATURE:
        raise BadImage("not a PNG file")
    at, packed, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise BadImage("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise BadImage("only 8 bits a channel without interlacing")
    w, h, _, kind, *_ = head
    if not w or not h:
        raise BadImage("no pixels")
    n = CHANNELS[kind]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise BadImage("damaged pixels") from error
    if len(raw) != h * (w * n + 1):
        raise BadImage("pixels are missing")
    values = _unfiltered(raw.reshape(h, w * n + 1), n).reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        if palette is None or values.max() >= len(palette):
            raise BadImage("palette entry missing")
        out[:, :, :3] = palette[values[:, :, 0]]
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[:, :, 3] = alpha[values[:, :, 0]]
    else:
        out[:, :, :3] = values[:, :, :1] if n < 3 else values[:, :, :3]
        if n in (2, 4):
            out[:, :, 3] = values[:, :, -1]
    return out, kind in (4, 6) or (kind == 3 and bool(clear))


def _unfiltered(rows: np.ndarray, n: int) -> np.ndarray:
    h, w = rows.shape[0], rows.shape[1] - 1
    out, above = np.zeros((h, w), np.uint8), np.zeros(w, np.uint8)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            new = out[y]
            for i in range(w):
                left, up = (int(new[i - n]) if i >= n else 0), int(above[i])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[i - n]) if i >= n else 0
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                new[i] = (int(line[i]) + guess) & 255
        else:
            raise BadImage("unknown filter")
        above = out[y]
    return out


def encode(rgba: np.ndarray, alpha: bool = True) -> bytes:
    """An RGBA or RGB file."""
    h, w = rgba.shape[:2]
    n = 4 if alpha else 3
    rows = np.zeros((h, w * n + 1), np.uint8)
    rows[:, 1:] = rgba[:, :, :n].reshape(h, w * n)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
