"""Grey images as PNG files, for reports."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def grey_png(grey: np.ndarray, note: str = "") -> bytes:
    """An 8-bit grey PNG; a note goes into a text chunk."""

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = grey.shape
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = grey
    text = part(b"iTXt", b"Comment\0\0\0\0\0" + note.encode()) if note else b""
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + text + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def shrunk(grey: np.ndarray, width: int) -> np.ndarray:
    """The image at a width, its rows in proportion, by nearest points."""
    height = max(1, round(grey.shape[0] * width / grey.shape[1]))
    return grey[np.arange(height) * grey.shape[0] // height][:, np.arange(width) * grey.shape[1] // width]


def outlined(grey: np.ndarray, boxes: list[tuple[float, float, float, float]], dpi: float, thick: int = 3) -> np.ndarray:
    """A copy with the outlines of boxes in points, half dark."""
    out, unit = grey.copy(), dpi / 72
    height, width = out.shape
    for left, top, right, bottom in boxes:
        x0, x1 = (int(min(max(v * unit, 0), width - 1)) for v in (left, right))
        y0, y1 = (int(min(max(v * unit, 0), height - 1)) for v in (top, bottom))
        out[y0 : y0 + thick, x0 : x1 + 1] = 128
        out[y1 : y1 + thick, x0 : x1 + 1] = 128
        out[y0 : y1 + 1, x0 : x0 + thick] = 128
        out[y0 : y1 + 1, x1 : x1 + thick] = 128
    return out
