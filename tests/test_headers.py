"""Facts of picture files built here byte by byte."""

import struct

import numpy as np
import pytest

from kinsift.sources import headers
from tests.test_pictures import png


def segment(marker, body):
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def tiff(entries, little=False):
    order = "<" if little else ">"
    body = b"".join(struct.pack(order + "HHI", tag, kind, 1) + value for tag, kind, value in entries)
    return (b"II" if little else b"MM") + struct.pack(order + "HIH", 42, 8, len(entries)) + body + b"\0\0\0\0"


def jpeg(*segments, bits=8, data=b"\x11\xff\x00\x22\xff\xd0\x33", end=b"\xff\xd9", tail=b""):
    frame = segment(0xC0, bytes((bits, 0, 20, 0, 30, 1, 1, 0x11, 0)))
    return b"\xff\xd8" + b"".join(segments) + frame + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + data + end + tail


def test_jpeg_ends_and_trailers():
    whole = jpeg()
    assert headers.jpeg_end(whole) == ("at", len(whole)) and headers.jpeg_end(jpeg(end=b""))[0] == "cut" and headers.jpeg_end(whole[:-1])[0] == "cut" and headers.jpeg_end(whole[:30])[0] == "cut"
    assert headers.jpeg_end(b"\xff\xd8\x00\x00")[0] == "unread" and headers.jpeg_end(b"\xff\xd8\xff\xe0\x00\x01")[0] == "unread"
    # an end marker in a thumbnail, or across bytes, is no end
    thumbnail = segment(0xE1, b"Exif\0\0" + jpeg())
    assert headers.jpeg_facts(jpeg(thumbnail, end=b"")).damaged and headers.jpeg_facts(jpeg(data=b"\x0f\xfd\x90", end=b"")).damaged and not headers.jpeg_facts(jpeg(thumbnail)).damaged
    assert headers.jpeg_facts(jpeg(tail=b"\0" * 9)).several is False and headers.jpeg_facts(jpeg(tail=jpeg())).several and headers.jpeg_facts(jpeg(tail=b"\0\0\0\x18ftypmp42")).several
    assert headers.jpeg_facts(jpeg(tail=b"\xff\xff\xff\x18ftypmp42")).several is False


@pytest.mark.parametrize("little", [False, True])
def test_jpeg_facts(little):
    order = "<" if little else ">"
    turn = segment(0xE1, b"Exif\0\0" + tiff([(0x0112, 3, struct.pack(order + "HH", 6, 0))], little))
    facts = headers.jpeg_facts(jpeg(turn, segment(0xE2, b"ICC_PROFILE\0\x01\x01"), bits=12))
    assert (facts.turned, facts.exif, facts.profile, facts.deep) == (True, True, True, True) and headers.shown_size(facts) == (20, 30)
    index = lambda n: segment(0xE2, b"MPF\0" + tiff([(0xB001, 4, struct.pack(order + "I", n))], little))
    assert headers.jpeg_facts(jpeg(index(2))).several and not headers.jpeg_facts(jpeg(index(1))).several
    kinds = struct.pack(order + "4I", 0x030000, 0, 0, 0) + struct.pack(order + "4I", 0x010001, 0, 0, 0)
    directory = (b"II" if little else b"MM") + struct.pack(order + "HIH", 42, 8, 1) + struct.pack(order + "HHII", 0xB002, 7, 32, 26) + b"\0" * 4
    assert not headers.jpeg_facts(jpeg(segment(0xE2, b"MPF\0" + directory + kinds))).several


def test_jpeg_coding_is_without_metadata():
    plain, tagged = jpeg(), jpeg(segment(0xE1, b"Exif\0\0"), segment(0xFE, b"said"))
    assert headers.jpeg_facts(plain).coding == headers.jpeg_facts(tagged).coding is not None and headers.jpeg_facts(jpeg(data=b"\x12")).coding != headers.jpeg_facts(plain).coding
    assert headers.jpeg_coding(plain[:20]) is None


def chunk(kind, body=b""):
    return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"


def test_png_facts():
    whole = png(np.zeros((7, 5)))
    facts = headers.png_facts(whole)
    assert (facts.width, facts.height, facts.damaged, facts.lossless, facts.several) == (5, 7, False, True, False)
    assert headers.png_facts(whole[:-4]).damaged is False and headers.png_facts(whole[:-13]).damaged
    head = headers.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 16, 3, 0, 0, 0))
    facts = headers.png_facts(head + chunk(b"acTL", struct.pack(">II", 3, 0)) + chunk(b"iCCP") + chunk(b"eXIf", tiff([(0x0112, 3, b"\0\x08\0\0")])) + chunk(b"IDAT") + chunk(b"IEND"))
    assert (facts.several, facts.profile, facts.exif, facts.deep, facts.lossless, headers.shown_size(facts)) == (True, True, True, True, False, (7, 5))
    one = lambda *parts: headers.png_facts(head + b"".join(parts) + chunk(b"IDAT") + chunk(b"IEND")).several
    assert one(chunk(b"acTL", struct.pack(">II", 1, 0))) and not one(chunk(b"acTL", struct.pack(">II", 1, 0)), chunk(b"fcTL"))


def test_other_formats():
    entry = lambda w, bits, size, at: struct.pack("<BBBBHHII", w % 256, w % 256, 0, 0, 1, bits, size, at)
    two = struct.pack("<HHH", 0, 1, 2) + entry(16, 8, 4, 38) + entry(256, 32, 4, 42) + b"abcdefgh"
    assert headers.ico_entry(two) == (2, b"efgh") and headers.ico_facts(two).several and headers.ico_entry(two[:40]) is None
    chunks = lambda *names: b"RIFF\0\0\0\0WEBP" + b"".join(n + b"\x01\0\0\0x\0" for n in names)
    assert headers.webp_lossless(chunks(b"VP8X", b"VP8L")) and headers.webp_lossless(chunks(b"VP8 ")) is False and headers.webp_lossless(chunks(b"VP8X")) is None
    frame = b"ANMF" + struct.pack("<I", 26) + b"\0" * 16 + b"VP8L\x02\0\0\0xx"
    animated = headers.webp_facts(chunks(b"ICCP", b"EXIF") + frame + frame)
    assert (animated.several, animated.lossless, animated.profile, animated.exif) == (True, True, True, True)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6
    image = b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x01x\0"
    assert headers.gif_frames(gif + b"\x21\xf9\x02ab\0" + image + image + b"\x3b") == 2 and headers.gif_frames(gif + image) == 1 and headers.gif_frames(gif + image[:12]) == 1 and headers.gif_frames(b"GIF") == 0
    assert headers.tiff_facts(tiff([(259, 3, b"\0\x07\0\0"), (258, 3, b"\0\x10\0\0"), (34665, 4, b"\0" * 4)])) == headers.Facts("tiff", lossless=False, deep=True, exif=True)
    assert headers.tiff_facts(tiff([(254, 4, b"\0\0\0\x01")])).several and not headers.tiff_facts(tiff([(259, 3, b"\x05\0\0\0")], True)).several and headers.tiff_facts(b"II").several is False
    assert headers.pnm_most(b"P5\n# 1 2 3\n2 2 65535\n") == 65535 and headers.pnm_most(b"P7\nWIDTH 2\nMAXVAL 255\nENDHDR\n") == 255 and headers.pnm_most(b"P1 2 2 ") is None
    assert headers.heif_facts(struct.pack(">I", 24) + b"ftypheic\0\0\0\0mif1msf1").several and not headers.heif_facts(struct.pack(">I", 20) + b"ftypheic\0\0\0\0mif1").several
    assert not headers.bmp_facts(b"BM" + b"\0" * 12 + struct.pack("<IIIHH", 40, 1, 1, 1, 8)).lossless and headers.bmp_facts(b"BM" + b"\0" * 12 + struct.pack("<IIIHH", 40, 1, 1, 1, 24)).lossless


def test_cut_files_never_fail():
    r = np.random.default_rng(0)
    for kind, facts in headers.FORMATS.items():
        for data in (b"", b"\xff", jpeg(), png(np.zeros((3, 3))), tiff([(258, 3, b"\0\x08\0\0")]), r.integers(0, 256, 300, np.uint8).tobytes()):
            for n in range(0, len(data) + 1, 7):
                assert facts(data[:n]).format == kind


def test_facts_of_a_table(spark):
    rows = [(1, "jpeg", jpeg()), (2, "png", png(np.zeros((4, 9)))), (3, None, b"text"), (4, "jxl", b"x"), (5, "gif", None)]
    found = {r["id"]: r for r in headers.header_facts(spark.createDataFrame(rows, "id long, format string, content binary"), "id").collect()}
    assert (found[1]["width"], found[1]["damaged"], found[2]["height"]) == (30, False, 4) and all(found[i]["damaged"] is None for i in (3, 4, 5))
