"""Uploaded pictures: kind by their first bytes, size limit, dimensions, and camera fields out of the picture directory."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 25 * 1024 * 1024
SHAPE = "name string, length long, kind string, width int, height int, make string, model string, taken string, lat double, lon double, problem string"
_NAMES = [x.split()[0] for x in SHAPE.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in SHAPE.split(", ")]
# Fixed values of the picture directory: bytes of a value by its type, and numbers of fields.
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
MAKE, MODEL, CHANGED, TAKEN, CAMERA, PLACE = 0x010F, 0x0110, 0x0132, 0x9003, 0x8769, 0x8825
LAT_SIDE, LAT, LON_SIDE, LON = 1, 2, 3, 4
#: Frame headers of a JPEG: all markers of that range but tables (C4), reserved (C8) and arithmetic conditioning (CC).
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def kind_of(content: bytes) -> str | None:
    if content[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":  # other sounds and films are RIFF as well
        return "webp"
    return None


def directory(tiff: bytes) -> tuple[dict[tuple[int, int], object], bool]:
    """(group, field) to value, group 0 or the field that leads to it; and whether something in it was broken.

    A field whose value would lie outside, or of unknown type, is passed over; a directory is read once, so circles end.
    """
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return {}, True
    found: dict[tuple[int, int], object] = {}
    seen, todo, broken = set(), [(0, struct.unpack_from(order + "I", tiff, 4)[0])], False
    while todo:
        group, at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            broken = True
            continue
        seen.add(at)
        entries = struct.unpack_from(order + "H", tiff, at)[0]
        for k in range(entries):
            place = at + 2 + 12 * k
            if place + 12 > len(tiff):
                broken = True
                break
            field, kind, n = struct.unpack_from(order + "HHI", tiff, place)
            size = WIDTHS.get(kind, 0) * n
            start = place + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, place + 8)[0]
            if not size or start + size > len(tiff):
                broken = True
            elif kind == 2:
                found[group, field] = tiff[start : start + n].split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind in (5, 10):
                pairs = struct.unpack_from(order + ("Ii"[kind == 10]) * 2 * n, tiff, start)
                found[group, field] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            elif kind in (3, 4):
                found[group, field] = struct.unpack_from(order + "HI"[kind == 4], tiff, start)[0]
                if field in (CAMERA, PLACE) and group == 0:
                    todo.append((field, found[group, field]))
    return found, broken


def degrees(parts: object, side: object, most: int) -> float | None:
    """Degrees, minutes and seconds with N, S, E or W; None if any is missing or out of range."""
    if not isinstance(parts, list) or len(parts) != 3 or None in parts or side not in ("N", "S", "E", "W"):
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return None if not (0 <= value <= most and parts[1] < 60 and parts[2] < 60) else -value if side in ("S", "W") else value


def moment(text: object) -> str | None:
    try:
        return datetime.strptime(str(text), "%Y:%m:%d %H:%M:%S").isoformat(" ")
    except ValueError:
        return None


def _jpeg(content: bytes) -> tuple[tuple[int, int] | None, bytes | None]:
    """Width and height, and the picture directory, out of the segments before the picture itself."""
    at, size, exif = 2, None, None
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xD9, 0xDA):
            break
        length = int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + length]
        if marker in FRAMES and len(body) >= 5:
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
        elif marker == 0xE1 and body[:6] == b"Exif\0\0" and exif is None:
            exif = body[6:]
        at += 2 + max(2, length)
    return size, exif


def _webp(content: bytes) -> tuple[int, int] | None:
    form, b = content[12:16], content[20:]
    if form == b"VP8X" and len(b) >= 10:
        return 1 + int.from_bytes(b[4:7], "little"), 1 + int.from_bytes(b[7:10], "little")
    if form == b"VP8 " and len(b) >= 10 and b[3:6] == b"\x9d\x01\x2a":
        return int.from_bytes(b[6:8], "little") & 0x3FFF, int.from_bytes(b[8:10], "little") & 0x3FFF
    if form == b"VP8L" and len(b) >= 5 and b[0] == 0x2F:
        bits = int.from_bytes(b[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def looked_at(name: str | None, content: bytes) -> tuple:
    kind = kind_of(content)
    if kind is None:
        return name, len(content), None, None, None, None, None, None, None, None, "no picture"
    exif, problem = None, None
    if kind == "jpeg":
        size, exif = _jpeg(content)
    elif kind == "png":
        size = struct.unpack_from(">II", content, 16) if content[12:16] == b"IHDR" and len(content) >= 24 else None
    else:
        size = _webp(content)
    fields, broken = directory(exif) if exif is not None else ({}, False)
    if size is None or 0 in size or max(size) >= 2**31:
        size, problem = (None, None), "no dimensions"
    elif broken:
        problem = "broken directory"
    text = lambda *key: fields.get(key) or None
    place = [degrees(fields.get((PLACE, f)), fields.get((PLACE, s)), most) for f, s, most in ((LAT, LAT_SIDE, 90), (LON, LON_SIDE, 180))]
    place = [None, None] if None in place else place
    return name, len(content), kind, *size, text(0, MAKE), text(0, MODEL), moment(fields.get((CAMERA, TAKEN), fields.get((0, CHANGED)))), *place, problem


def inspected(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a file of (name, length, content): SHAPE. What is larger than ``limit`` is refused by its length alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [looked_at(n, c or b"") for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), _TYPES, strict=True)], _NAMES)

    small = files.where(F.coalesce("length", F.lit(0)) <= limit).select("name", "content").mapInArrow(of, SHAPE)
    large = files.where(F.col("length") > limit).select("name", "length", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SHAPE.split(", ")[2:-1]), F.lit("too large").alias("problem"))
    return small.unionByName(large)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, content) of the files below a path. A filter on ``length`` reaches the source: the content of a
    file that it leaves out is not read, nor is that of files of which only names and lengths are asked for. Empty files are
    passed over by the source."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("name"), "length", "content")
