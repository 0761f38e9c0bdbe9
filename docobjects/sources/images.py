"""Facts on images from their bytes: header sizes, JPEG quality, flat shadow layers, resizing of plain samples."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed value: the most pixels that are decoded.
MOST_PIXELS = 80_000_000

# The standard luminance quantisation table of the JPEG standard (annex K), row by row.
STANDARD_LUMINANCE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61],
        [12, 12, 14, 19, 26, 58, 60, 55],
        [14, 13, 16, 24, 40, 57, 69, 56],
        [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77],
        [24, 35, 55, 64, 81, 104, 113, 92],
        [49, 64, 78, 87, 103, 121, 120, 101],
        [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG (first chunk) or JPEG (frame header); None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24]) if len(data) >= 24 and data[12:16] == b"IHDR" else None
    if data[:2] != b"\xff\xd8":
        return None
    for marker, body in _segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return (struct.unpack(">H", body[3:5])[0], struct.unpack(">H", body[1:3])[0]) if len(body) >= 5 else None
    return None


def _segments(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, data[at + 4 : at + 2 + size]
        if marker == 0xDA or size < 2:
            return
        at += 2 + size


def safe_to_decode(data: bytes) -> bool:
    """The header states positive dimensions with at most MOST_PIXELS pixels."""
    size = dimensions(data)
    return bool(size and size[0] > 0 and size[1] > 0 and size[0] * size[1] <= MOST_PIXELS)


def scaled_sum(quality: int) -> int:
    """Sum of the standard table scaled to a quality by the usual rule."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return int(np.clip((STANDARD_LUMINANCE * scale + 50) // 100, 1, 255).sum())


def jpeg_quality(data: bytes) -> int | None:
    """The quality whose scaled table is nearest to the first quantisation table by sum; the lowest of equals."""
    if data[:2] != b"\xff\xd8":
        return None
    for marker, body in _segments(data):
        if marker == 0xDB and body:
            wide = body[0] >> 4
            table = body[1 : 1 + (128 if wide else 64)]
            if len(table) < (128 if wide else 64):
                return None
            total = sum(struct.unpack(">64H", table)) if wide else sum(table)
            return min(range(1, 101), key=lambda q: (abs(scaled_sum(q) - total), q))
    return None


def is_flat(samples: bytes, width: int, height: int, channels: int) -> bool:
    """Every channel has one value all over."""
    need = width * height * channels
    if need <= 0 or len(samples) < need:
        return False
    pixels = np.frombuffer(samples, np.uint8, need).reshape(-1, channels)
    return bool((pixels == pixels[0]).all())


def _cubic(n_in: int, n_out: int) -> np.ndarray:
    """Rows of weights of a bicubic (a = -0.5) resampling, widened when it shrinks."""
    ratio = n_in / n_out
    reach = max(ratio, 1.0)
    centre = (np.arange(n_out) + 0.5) * ratio - 0.5
    t = np.abs(np.arange(n_in)[None, :] - centre[:, None]) / reach
    w = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resize(samples: bytes, width: int, height: int, channels: int, new_width: int, new_height: int) -> bytes | None:
    """Eight-bit samples at another size; None if there are too few of them."""
    need = width * height * channels
    if min(width, height, new_width, new_height) <= 0 or len(samples) < need:
        return None
    pixels = np.frombuffer(samples, np.uint8, need).reshape(height, width, channels).astype(np.float64)
    out = np.einsum("ih,hwc->iwc", _cubic(height, new_height), pixels)
    out = np.einsum("jw,iwc->ijc", _cubic(width, new_width), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).tobytes()
