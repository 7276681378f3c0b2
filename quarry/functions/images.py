"""Format, dimensions and transparency of images, from their headers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

COLUMNS = "path string, format string, width int, height int, alpha boolean"


def header(b: bytes) -> tuple[str | None, int | None, int | None, bool | None]:
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 26:
        w, h = struct.unpack(">II", b[16:24])
        return "PNG", w, h, b[25] in (4, 6) or b"tRNS" in b[:4096]
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        w, h = struct.unpack("<HH", b[6:10])
        return "GIF", w, h, b"\x21\xf9\x04\x01" in b
    if b[:2] == b"BM" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return "BMP", w, abs(h), False
    if b[:4] == b"\x00\x00\x01\x00" and len(b) >= 8:
        return "ICO", b[6] or 256, b[7] or 256, True
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and b[12:16] == b"VP8X" and len(b) >= 30:
        return "WEBP", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), bool(b[20] & 16)
    if b[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(b) and b[i] == 0xFF:
            if b[i + 1] in (0xC0, 0xC1, 0xC2):
                h, w = struct.unpack(">HH", b[i + 5 : i + 9])
                return "JPEG", w, h, False
            i += 2 + int.from_bytes(b[i + 2 : i + 4], "big")
    return None, None, None, None


def pixels(b: bytes, most: int = 100) -> np.ndarray | None:
    """Colours of a PNG of 8 bits a channel without interlace, thinned to about ``most`` rows and columns; else None."""
    if b[:8] != b"\x89PNG\r\n\x1a\n" or len(b) < 33:
        return None
    width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", b[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if bits != 8 or interlaced or channels is None:
        return None
    packed, palette, i = b"", None, 8
    while i + 8 <= len(b):
        n, name = struct.unpack(">I4s", b[i : i + 8])
        if name == b"IDAT":
            packed += b[i + 8 : i + 8 + n]
        elif name == b"PLTE":
            palette = np.frombuffer(b[i + 8 : i + 8 + n], np.uint8).reshape(-1, 3)
        i += 12 + n
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError):
        return None
    rows, above = [], np.zeros(width * channels, np.int64)
    for line in raw:
        how, row = line[0], line[1:].astype(np.int64)
        if how == 2:
            row = (row + above) & 255
        elif how:
            for x in range(len(row)):
                left = row[x - channels] if x >= channels else 0
                corner = above[x - channels] if x >= channels else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                row[x] = (row[x] + guess) & 255
        rows.append(row)
        above = row
    image = np.array(rows, np.uint8).reshape(height, width, channels)[:: max(1, height // most), :: max(1, width // most)]
    flat = image.reshape(-1, channels)
    if kind == 3:
        return None if palette is None else palette[np.minimum(flat[:, 0], len(palette) - 1)]
    return np.repeat(flat[:, :1], 3, axis=1) if kind in (0, 4) else flat[:, :3]


def colours(files: DataFrame, top: int = 3) -> DataFrame:
    """(path, rank, colour, share): the most common colours of each image that can be read, as #rrggbb."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                got = pixels(bytes(content or b""))
                if got is None or not len(got):
                    continue
                seen, n = np.unique(got, axis=0, return_counts=True)
                for rank, k in enumerate(sorted(range(len(n)), key=lambda k: (-n[k], tuple(seen[k])))[:top], 1):
                    out.append((path, rank, "#%02x%02x%02x" % tuple(seen[k]), n[k] / n.sum()))
            yield pd.DataFrame(out, columns=["path", "rank", "colour", "share"])

    return files.select("path", "content").mapInPandas(run, "path string, rank int, colour string, share double")


def meta(files: DataFrame) -> DataFrame:
    """files (path, content binary) as one row each; a null format where no header is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([(p, *header(bytes(c or b""))) for p, c in zip(b["path"], b["content"], strict=True)], columns=[c.split()[0] for c in COLUMNS.split(", ")])
            yield rows.astype({"width": "Int32", "height": "Int32", "alpha": "boolean"})

    return files.select("path", "content").mapInPandas(run, COLUMNS)


def samples(spark: SparkSession) -> DataFrame:
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 64, 32, 8, 6, 0, 0, 0)
    return spark.createDataFrame([("a.png", bytearray(png)), ("b.gif", bytearray(b"GIF89a" + struct.pack("<HH", 5, 7))), ("c.bin", bytearray(b"xx"))], "path string, content binary")


def painted(spark: SparkSession) -> DataFrame:
    """Two small images with pixels: one by all line filters, one by a palette."""

    def png(width: int, height: int, kind: int, lines: bytes, *extra: tuple[bytes, bytes]) -> bytes:
        parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)), *extra, (b"IDAT", zlib.compress(lines)), (b"IEND", b"")]
        return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) for name, body in parts)

    red, step = bytes([255, 0, 0]), bytes(3)
    lines = b"\0" + red * 4 + b"\1" + red + step * 3 + b"\2" + step * 4 + b"\3" + bytes([0, 0, 255]) * 1 + bytes([0, 0, 0]) * 3 + b"\4" + step * 4
    rows = [("filters.png", bytearray(png(4, 5, 2, lines))), ("palette.png", bytearray(png(3, 1, 3, b"\0\1\1\0", (b"PLTE", bytes([0, 0, 0, 0, 128, 0])))))]
    return spark.createDataFrame(rows, "path string, content binary")
