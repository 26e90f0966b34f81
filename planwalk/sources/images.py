"""Images as pixel tables: 8-bit PNG and binary PPM files, read whole folders at once."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, x bigint, y bigint, r int, g int, b int"


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def decode_png(data: bytes) -> np.ndarray:
    """[rows, columns, 3] of an 8-bit gray, RGB or RGBA file without interlacing; transparency is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, width, height, kind = 8, [], 0, 0, -1
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or kind not in (0, 2, 6) or laced:
                raise ValueError("a kind of PNG that isn't read")
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    step = {0: 1, 2: 3, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width, step), np.int64)
    above = np.zeros((width, step), np.int64)
    for y in range(height):
        how, raw = int(lines[y, 0]), lines[y, 1:].reshape(width, step).astype(np.int64)
        if how == 0:
            row = raw
        elif how == 1:
            row = np.cumsum(raw, axis=0) & 255
        elif how == 2:
            row = (raw + above) & 255
        else:
            row, left, corner = np.zeros_like(raw), np.zeros(step, np.int64), np.zeros(step, np.int64)
            for x in range(width):
                guess = (left + above[x]) // 2 if how == 3 else _paeth(left, above[x], corner)
                left = (raw[x] + guess) & 255
                corner = above[x]
                row[x] = left
        out[y] = above = row
    return np.repeat(out, 3, axis=2) if step == 1 else out[:, :, :3]


def decode_ppm(data: bytes) -> np.ndarray:
    """[rows, columns, 3] of a binary PPM file of 8 bits a channel; comments are passed over."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while data[end : end + 1] not in (b" ", b"\t", b"\n", b"\r", b"#", b""):
            end += 1
        if end > at:
            fields.append(data[at:end])
        if data[end : end + 1] == b"#":
            end = data.index(b"\n", end)
        at = end + 1
    if fields[0] != b"P6" or int(fields[3]) > 255:
        raise ValueError("a kind of PPM that isn't read")
    width, height = int(fields[1]), int(fields[2])
    return np.frombuffer(data, np.uint8, 3 * width * height, at).reshape(height, width, 3).astype(np.int64)


def decode(data: bytes) -> np.ndarray:
    return decode_png(data) if data[:1] == b"\x89" else decode_ppm(data)


def pixels(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """(path, x, y, r, g, b) of all pixels of the image files below folder; a task holds one image."""

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                image = decode(bytes(content))
                y, x = np.divmod(np.arange(image.shape[0] * image.shape[1]), image.shape[1])
                r, g, b = image.reshape(-1, 3).T.astype(np.int32)
                yield pd.DataFrame({"path": path, "x": x, "y": y, "r": r, "g": g, "b": b})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content").mapInPandas(run, PIXELS)


def sizes(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """(path, width, height, encoded): each image's size, and its bytes as base64 text."""

    def run(frames):
        for frame in frames:
            shapes = [decode(bytes(x)).shape for x in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "width": [s[1] for s in shapes], "height": [s[0] for s in shapes], "content": frame["content"]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    found = files.select("path", "content").mapInPandas(run, "path string, width int, height int, content binary")
    return found.select("path", "width", "height", F.base64("content").alias("encoded"))
