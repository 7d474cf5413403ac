"""Uploads: files on disk, refused sizes, both byte orders, and directories broken in every way."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terravow.sources import uploads
from terravow.sources.queries import planted_pictures


def tiff(order="<", fields=(), camera=(), place=(), after=0):
    """A directory with its values behind it; fields are (number, type, values as bytes, count)."""

    def one(entries, at, pointers=()):
        body, tail = b"", b""
        start = at + 2 + 12 * (len(entries) + len(pointers)) + 4
        for number, kind, value, n in entries:
            if len(value) <= 4:
                held = value.ljust(4, b"\0")
            else:
                held = struct.pack(order + "I", start + len(tail))
                tail += value
            body += struct.pack(order + "HHI", number, kind, n) + held
        body += b"".join(struct.pack(order + "HHII", number, 4, 1, to) for number, to in pointers)
        return struct.pack(order + "H", len(entries) + len(pointers)) + body + struct.pack(order + "I", after) + tail

    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    size = lambda x, n=0: len(one(x, 0)) + 12 * n
    second = 8 + size(fields, 2)
    third = second + size(camera)
    return head + one(fields, 8, ((uploads.CAMERA, second), (uploads.PLACE, third))) + one(camera, second) + one(place, third)


def ascii_field(number, text):
    return number, 2, text.encode() + b"\0", len(text) + 1


def dms(number, order, *parts):
    return number, 5, b"".join(struct.pack(order + "II", *p) for p in parts), len(parts)


def jpeg(exif=None, size=(640, 480)):
    segments = b"\xff\xe0\x00\x04ab"
    if exif is not None:
        segments += b"\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif
    return b"\xff\xd8" + segments + b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", size[1], size[0]) + bytes(10) + b"\xff\xd9"


def whole(order):
    return tiff(
        order,
        [ascii_field(uploads.MAKE, "Acme"), ascii_field(uploads.MODEL, " Cam 7 "), ascii_field(uploads.CHANGED, "2020:01:01 00:00:00")],
        [ascii_field(uploads.TAKEN, "2024:05:06 07:08:09")],
        [ascii_field(uploads.LAT_SIDE, "S"), dms(uploads.LAT, order, (18, 1), (30, 1), (900, 100)), ascii_field(uploads.LON_SIDE, "E"), dms(uploads.LON, order, (73, 1), (0, 1), (0, 1))],
    )


@pytest.mark.parametrize("order", ["<", ">"])
def test_camera_fields(order):
    row = dict(zip(uploads._NAMES, uploads.looked_at("a", jpeg(whole(order))), strict=True))
    assert row | {"name": "a"} == {
        "name": "a", "length": row["length"], "kind": "jpeg", "width": 640, "height": 480, "make": "Acme", "model": "Cam 7",
        "taken": "2024-05-06 07:08:09", "lat": -(18 + 30 / 60 + 9 / 3600), "lon": 73.0, "problem": None,
    }


def test_places_out_of_range_are_missing():
    good = [(18, 1), (30, 1), (0, 1)]
    for bad in ([(91, 1), (0, 1), (0, 1)], [(18, 1), (60, 1), (0, 1)], [(18, 1), (30, 0), (0, 1)], [(18, 1), (30, 1)]):
        exif = tiff("<", [], [], [ascii_field(uploads.LAT_SIDE, "N"), dms(uploads.LAT, "<", *bad), ascii_field(uploads.LON_SIDE, "E"), dms(uploads.LON, "<", *good)])
        assert uploads.looked_at("a", jpeg(exif))[8:10] == (None, None)
    exif = tiff("<", [], [], [dms(uploads.LAT, "<", *good), dms(uploads.LON, "<", *good)])
    assert uploads.looked_at("a", jpeg(exif))[8:10] == (None, None)  # without N or S


def test_broken_directories():
    exif = whole("<")
    for cut in range(len(exif)):
        assert uploads.looked_at("a", jpeg(exif[:cut]))[10] == "broken directory"
    circle = bytearray(tiff("<"))
    struct.pack_into("<I", circle, 8 + 2 + 8, 8)  # leads back to where it is
    assert uploads.looked_at("a", jpeg(bytes(circle)))[10] == "broken directory"
    assert uploads.looked_at("a", jpeg(tiff("<", [(uploads.MAKE, 99, b"abc", 3)])))[10] == "broken directory"
    assert uploads.looked_at("a", jpeg(None))[10] is None


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200), st.sampled_from([b"", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"RIFF\0\0\0\0WEBP", jpeg(whole(">"))[:60], jpeg(whole("<"))]), st.integers(0, 400), st.integers(0, 255))
def test_any_bytes_have_a_result(tail, head, at, octet):
    content = bytearray(head + tail)
    if content:
        content[at % len(content)] = octet
    assert len(uploads.looked_at("a", bytes(content))) == len(uploads._NAMES)


def test_files_and_refused_sizes(spark, tmp_path):
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 321, 123)
    wide = b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (999).to_bytes(3, "little") + (499).to_bytes(3, "little")
    files = {"a.png": jpeg(whole("<")), "b.jpg": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 7, 9), "c": lossy, "d": wide, "e.wav": b"RIFF\0\0\0\0WAVEfmt ", "f": b"", "big.jpg": jpeg() + bytes(5000)}
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    rows = uploads.inspected(uploads.uploads(spark, f"file://{tmp_path}"), limit=2000).collect()
    found = {r["name"].rsplit("/", 1)[1]: (r["kind"], r["width"], r["height"], r["problem"]) for r in rows}
    assert found == {
        "a.png": ("jpeg", 640, 480, None), "b.jpg": ("png", 7, 9, None), "c": ("webp", 321, 123, None), "d": ("webp", 1000, 500, None),
        "e.wav": (None, None, None, "no picture"), "big.jpg": (None, None, None, "too large"),
    }
    assert uploads.looked_at("f", b"")[10] == "no picture"  # an empty file is not listed by the source
    assert uploads.LIMIT == 25 * 1024 * 1024


def test_planted_pictures_hold_their_texts(spark, small):
    rows = planted_pictures(spark, small).where("length(content) <> length").count()
    assert rows == 0
