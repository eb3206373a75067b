"""PNG and npy payloads and resampling, in numpy for Arrow batches.

PNG: 8 bits, grey, grey with alpha, RGB and RGBA, not interlaced; written with
filter 0, read with all five filters.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}
_CHANNELS = {v: k for k, v in _COLOUR.items()}


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """uint8 [height, width, channels] to PNG bytes."""
    height, width, channels = image.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((height, 1 + width * channels), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, _COLOUR[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def is_png(payload: bytes | None) -> bool:
    """Whether a payload can be opened: signature and a header of a kind that is read here."""
    if not payload or len(payload) < 33 or payload[:8] != SIGNATURE or payload[12:16] != b"IHDR":
        return False
    return payload[24] == 8 and payload[25] in _CHANNELS and payload[28] == 0


def decode_png(payload: bytes) -> np.ndarray:
    """PNG bytes to uint8 [height, width, channels]; ValueError if they can't be read."""
    if not is_png(payload):
        raise ValueError("not a PNG of a kind that is read here")
    at, body = 8, []
    while at < len(payload):
        n, kind = struct.unpack(">I4s", payload[at : at + 8])
        if kind == b"IDAT":
            body.append(payload[at + 8 : at + 8 + n])
        at += 12 + n
    width, height = struct.unpack(">II", payload[16:24])
    channels = _CHANNELS[payload[25]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.int32)
    for r in range(height):
        kind, line = raw[r, 0], raw[r, 1:].reshape(width, channels).astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line, axis=0)
        elif kind:
            left, corner = np.zeros(channels, np.int32), np.zeros(channels, np.int32)
            for c in range(width):
                if kind == 3:
                    guess = (left + above[c]) >> 1
                else:
                    p = left + above[c] - corner
                    a, b, d = abs(p - left), abs(p - above[c]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, above[c], corner))
                corner = above[c]
                left = line[c] = (line[c] + guess) & 255
        above = line & 255
        out[r] = above
    return out


def encode_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def decode_npy(payload: bytes) -> np.ndarray:
    return np.load(io.BytesIO(payload), allow_pickle=False)


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0))


#: Filters of resampling by name, as functions of the distance in pixels.
FILTERS = {
    "box": lambda t: ((t > -0.5) & (t <= 0.5)).astype(float),
    "bilinear": lambda t: np.maximum(0, 1 - np.abs(t)),
    "hamming": lambda t: np.where(np.abs(t) < 1, np.sinc(t) * (0.54 + 0.46 * np.cos(np.pi * t)), 0),
    "bicubic": _cubic,
    "lanczos": lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0),
}


def resize(image: np.ndarray, height: int, width: int, how: str = "nearest") -> np.ndarray:
    """[height, width, channels] resampled: nearest (pixel centres), or a filter of FILTERS with its
    support widened when shrinking; rounded back to the image's type."""
    if how == "nearest":
        r = np.minimum(((np.arange(height) + 0.5) * image.shape[0] / height).astype(int), image.shape[0] - 1)
        c = np.minimum(((np.arange(width) + 0.5) * image.shape[1] / width).astype(int), image.shape[1] - 1)
        return image[r][:, c]
    kernel = FILTERS[how]

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(old / new, 1.0)
        centre = (np.arange(new) + 0.5) * old / new
        w = kernel((np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale)
        return w / w.sum(axis=1, keepdims=True)

    out = np.einsum("ij,jkc->ikc", weights(image.shape[0], height), image.astype(float))
    out = np.einsum("kl,ilc->ikc", weights(image.shape[1], width), out)
    return np.clip(np.rint(out), 0, 255).astype(image.dtype) if image.dtype == np.uint8 else out.astype(image.dtype)


def overlay(images: list[np.ndarray]) -> np.ndarray:
    """RGBA images pasted in order, each through its own alpha."""
    base = images[0].astype(np.int32)
    for top in images[1:]:
        mask = top[..., 3:4].astype(np.int32)
        base = (top * mask + base * (255 - mask) + 127) // 255
    return base.astype(np.uint8)


def mosaic(children: dict[tuple[int, int], np.ndarray], how: str = "nearest") -> np.ndarray:
    """Children by (column, row) of their quadrant to one image of a child's size; absent ones stay clear."""
    some = next(iter(children.values()))
    h, w = some.shape[:2]
    canvas = np.zeros((2 * h, 2 * w, 4), np.uint8)
    for (dx, dy), image in children.items():
        rgba = image if image.shape[2] == 4 else np.dstack([image[..., :3], np.full((h, w), 255, np.uint8)])
        canvas[dy * h : (dy + 1) * h, dx * w : (dx + 1) * w] = rgba
    return resize(canvas, h, w, how)


def stitch(children: list[np.ndarray]) -> np.ndarray:
    """Four children (top left, top right, bottom right, bottom left) side by side, with alpha."""
    full = [c if c.shape[2] == 4 else np.dstack([c[..., :3], np.full(c.shape[:2], 255, np.uint8)]) for c in children]
    tl, tr, br, bl = full
    return np.vstack([np.hstack([tl, tr]), np.hstack([bl, br])])
