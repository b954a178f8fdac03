"""What a picture's file says of itself without being decoded: size, turn, damage, depth, profile, EXIF, further pictures, losslessness.

Every format is walked by its own generator of parts; a part that runs past the file's end ends the walk.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the formats: JPEG markers, tags of TIFF and EXIF directories, brands of image sequences.
SOI, EOI, SOS = 0xD8, 0xD9, 0xDA
STANDALONE = frozenset((0x01, *range(0xD0, 0xD9)))
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
METADATA = frozenset((*range(0xE0, 0xF0), 0xFE))
ORIENTATION, SUBFILE, BITS, COMPRESSION, MAKE, SUBIFDS, EXIF_IFD, ICC, DNG = 0x0112, 254, 258, 259, 271, 330, 34665, 34675, 50706
MP_COUNT, MP_ENTRIES, LARGE_THUMBNAILS = 0xB001, 0xB002, (0x010001, 0x010002)
SEQUENCES = (b"msf1", b"hevc", b"hevx", b"hevs", b"avis")
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


@dataclass
class Facts:
    """`damaged`: the file ends before its picture; `several`: it holds more than the one that decodes; `lossless`: of its pixels."""

    format: str | None = None
    width: int | None = None
    height: int | None = None
    turned: bool = False
    damaged: bool = False
    exif: bool = False
    several: bool = False
    lossless: bool = False
    deep: bool = False
    profile: bool = False
    coding: str | None = None


class Reader:
    """Numbers of either byte order; None past the end."""

    def __init__(self, data: bytes, little: bool):
        self.data, self.order = data, "little" if little else "big"

    def __call__(self, at: int, size: int) -> int | None:
        part = self.data[at : at + size] if at >= 0 else b""
        return int.from_bytes(part, self.order) if len(part) == size else None


def jpeg_segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, first byte, past the last) of each segment, the data of a scan among it; last one of marker 0 where the file ends first, -1 where it can't be read."""
    at = 2
    while True:
        start = at
        while data[at : at + 1] == b"\xff":
            at += 1
        if at >= len(data):
            yield 0, start, at
            return
        if at == start:
            yield -1, start, at
            return
        marker, at = data[at], at + 1
        if marker in STANDALONE or marker == EOI:
            yield marker, at - 2, at
            if marker == EOI:
                return
            continue
        length = int.from_bytes(data[at : at + 2], "big") if at + 2 <= len(data) else None
        if length is None or length < 2 or at + length > len(data):
            yield (-1 if length is not None and length < 2 else 0), at - 2, len(data)
            return
        first, at = at - 2, at + length
        if marker == SOS:
            found = _MARKER.search(data, at)
            if found is None:
                yield SOS, first, len(data)
                yield 0, len(data), len(data)
                return
            at = found.start()
        yield marker, first, at


def jpeg_end(data: bytes) -> tuple[str, int]:
    """('at', past the first picture), ('cut', ..) where the file ends first, ('unread', ..)."""
    marker, _, end = 0, 0, 0
    for marker, _, end in jpeg_segments(data):
        pass
    return {EOI: "at", 0: "cut"}.get(marker, "unread"), end


def holds_media(trailer: bytes) -> bool:
    """A further JPEG, or the video of a motion photo, after the picture's end."""
    boxes = (int.from_bytes(trailer[m.start() - 4 : m.start()], "big") for m in re.finditer(b"ftyp", trailer) if m.start() >= 4)
    return b"\xff\xd8\xff" in trailer or any(8 <= size <= 4096 for size in boxes)


def jpeg_coding(data: bytes) -> bytes | None:
    """A JPEG without its APPn and COM segments, its first scan and all after it as they are; None if it can't be walked that far."""
    kept = []
    for marker, first, end in jpeg_segments(data):
        if marker in (0, -1, EOI) or marker in STANDALONE:
            return None
        if marker == SOS:
            return b"".join([*kept, data[first:]])
        if marker not in METADATA:
            kept.append(data[first:end])
    return None


def directory(read: Reader, at: int, big: bool = False, most: int = 4096) -> Iterator[tuple[int, int, int, int]]:
    """(tag, type, count, where the value is) of a TIFF directory's entries."""
    head, entry, value = (8, 20, 8) if big else (2, 12, 4)
    for k in range(min(read(at, head) or 0, most)):
        o = at + head + k * entry
        tag = read(o, 2)
        if tag is None:
            return
        yield tag, read(o + 2, 2) or 0, read(o + 4, value) or 0, o + 4 + value


def tiff_reader(data: bytes) -> Reader | None:
    return Reader(data, data[:2] == b"II") if data[:2] in (b"II", b"MM") else None


def exif_orientation(tiff: bytes) -> int | None:
    read = tiff_reader(tiff)
    first = read(4, 4) if read else None
    if first is None:
        return None
    return next((read(at, 2) for tag, _, _, at in directory(read, first) if tag == ORIENTATION), None)


def turns(orientation: int | None) -> bool:
    return orientation is not None and 5 <= orientation <= 8


def mpf_pictures(segment: bytes) -> int:
    """Pictures of a multi-picture index, large thumbnails aside."""
    read = tiff_reader(segment)
    first = read(4, 4) if read else None
    if first is None:
        return 0
    entries = {tag: (count, at) for tag, _, count, at in directory(read, first, most=64)}
    if MP_ENTRIES in entries:
        size, at = entries[MP_ENTRIES]
        kinds = [read((read(at, 4) or 0) + 16 * k, 4) for k in range(min(size // 16, 64))]
        if kinds and None not in kinds:
            return sum((k & 0xFFFFFF) not in LARGE_THUMBNAILS for k in kinds)
    return (read(entries[MP_COUNT][1], 4) or 0) if MP_COUNT in entries else 0


def jpeg_facts(data: bytes) -> Facts:
    out, pictures, precision, ahead = Facts("jpeg"), 0, 0, True
    for marker, first, end in jpeg_segments(data):
        body = data[first + 4 : end]
        if marker == SOS:
            break
        if marker in FRAMES and len(body) >= 5:
            precision = body[0]
            out.height, out.width = struct.unpack(">HH", body[1:5])
            ahead = False
        elif marker == 0xE1 and body.startswith(b"Exif\0\0") and ahead and not out.turned:
            out.turned = turns(exif_orientation(body[6:]))
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            out.profile = True
        elif marker == 0xE2 and body.startswith(b"MPF\0"):
            pictures = mpf_pictures(body[4:])
    state, end = jpeg_end(data)
    out.damaged, out.deep, out.exif = state == "cut", precision > 8, b"Exif\0\0" in data[: 1 << 17]
    out.several = pictures >= 2 or (state == "at" and holds_media(data[end:]))
    coding = jpeg_coding(data)
    out.coding = hashlib.sha256(coding).hexdigest() if coding is not None else None
    return out


def png_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of its content, past it); the last may run past the end."""
    at = 8
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], at + 8, at + 8 + size
        if data[at + 4 : at + 8] == b"IEND":
            return
        at += 12 + size


def png_facts(data: bytes) -> Facts:
    out, frames, control, pixels, ended = Facts("png", lossless=not (data[12:16] == b"IHDR" and data[25:26] == b"\x03")), None, False, False, False
    out.width, out.height = Reader(data, False)(16, 4), Reader(data, False)(20, 4)
    out.damaged = True
    for kind, first, end in png_chunks(data):
        ended = kind == b"IEND"
        if not ended and end + 4 > len(data):
            out.exif |= kind == b"eXIf"
            break
        out.exif |= kind == b"eXIf"
        out.profile |= kind == b"iCCP"
        if not pixels:
            if kind == b"acTL":
                frames = Reader(data, False)(first, 4)
            control |= kind == b"fcTL"
            if kind == b"eXIf" and end - first <= 1 << 20:
                out.turned = turns(exif_orientation(data[first:end]))
        pixels |= kind == b"IDAT"
    out.damaged = not ended
    out.several = frames is not None and (frames > 1 or (frames == 1 and not control))
    out.deep = data[24:25] == b"\x10"
    return out


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def webp_lossless(data: bytes) -> bool | None:
    """By the first picture's chunk, of an animation its first frame's."""
    for kind, first, _ in riff_chunks(data):
        if kind in (b"VP8L", b"VP8 "):
            return kind == b"VP8L"
        if kind == b"ANMF":
            # 16 bytes of placement, then chunks of its own
            return webp_lossless(b" " * 12 + data[first + 16 :])
    return None


def webp_facts(data: bytes) -> Facts:
    kinds = [kind for kind, _, _ in riff_chunks(data)]
    return Facts("webp", exif=b"EXIF" in kinds, profile=b"ICCP" in kinds, lossless=webp_lossless(data) is True, several=kinds.count(b"ANMF") >= 2)


def gif_frames(data: bytes) -> int:
    """Image descriptors, as far as the blocks can be walked."""
    if len(data) < 13:
        return 0
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def past_blocks(at: int) -> int | None:
        while at < len(data):
            at, size = at + 1 + data[at], data[at]
            if not size:
                return at
        return None

    at, frames = 13 + colours(data[10]), 0
    while at is not None and at < len(data):
        if data[at] == 0x2C:
            frames += 1
            at = past_blocks(at + 11 + colours(data[at + 9])) if at + 9 < len(data) else None
        elif data[at] == 0x21:
            at = past_blocks(at + 2)
        else:
            break
    return frames


def ico_entry(data: bytes) -> tuple[int, bytes] | None:
    """(pictures, the one that is read): most bits a pixel, then most pixels; the last wins a tie, of the others the first."""
    read = Reader(data, True)
    if read(0, 2) != 0 or read(2, 2) not in (1, 2):
        return None
    entries = []
    for at in range(6, 6 + 16 * (read(4, 2) or 0), 16):
        if at + 16 > len(data):
            return None
        bits, size, where = struct.unpack("<6xHII", data[at : at + 16])
        entries.append((bits, (data[at] or 256) * (data[at + 1] or 256), where, size))
    if not entries:
        return None
    *others, last = entries
    best = max([last, *others], key=lambda e: e[:2])
    picture = data[best[2] : best[2] + best[3]]
    return (len(entries), picture) if len(picture) == best[3] else None


def ico_facts(data: bytes) -> Facts:
    found = ico_entry(data)
    if found is None:
        return Facts("ico", lossless=True)
    n, picture = found
    lossless = picture[25:26] not in (b"", b"\x03") if picture.startswith(PNG_HEAD) else (Reader(picture, True)(14, 2) or 0) > 8
    return Facts("ico", lossless=lossless, several=n >= 2)


def tiff_facts(data: bytes) -> Facts:
    """`several` also of what only looks like a TIFF: a raw file's preview and its picture are two."""
    read = tiff_reader(data)
    version = read(2, 2) if read else None
    if version not in (42, 43):
        return Facts("tiff")
    big = version == 43
    out, raw, pictures, seen, bits, compression = Facts("tiff"), data[8:10] == b"CR", 0, set(), 0, None
    at, value = read(8, 8) if big else read(4, 4), 8 if big else 4
    for k in range(64):
        if not at or at in seen or read(at, 8 if big else 2) is None:
            break
        seen.add(at)
        entries = list(directory(read, at, big))
        tags = {tag for tag, *_ in entries}
        reduced = any(tag == SUBFILE and ((read(where, 2 if kind == 3 else 4) or 0) & 1) for tag, kind, _, where in entries)
        if k == 0:
            out.exif, out.profile = EXIF_IFD in tags, ICC in tags
            raw |= DNG in tags or reduced or {MAKE, SUBIFDS} <= tags
            for tag, _, count, where in entries:
                if tag == BITS:
                    bits = read(where if 2 * count <= value else read(where, value) or 0, 2) or 0
                if tag == COMPRESSION and compression is None:
                    compression = read(where, 2)
        pictures += not reduced
        count = read(at, 8 if big else 2) or 0
        at = read(at + (8 if big else 2) + count * (20 if big else 12), value)
    out.several, out.deep = raw or pictures >= 2, bits > 8
    # old and new JPEG, and the lossy JPEG of raw files
    out.lossless = compression not in (6, 7, 34892)
    return out


def pnm_most(data: bytes) -> int | None:
    """The largest sample a PNM's head allows for."""
    head = data[:512].decode("utf-8", "ignore")
    if head.startswith("P7"):
        found = re.search(r"(?m)^\s*MAXVAL\s*(\d+)\s*$", head)
        return int(found[1]) if found else None
    words = re.sub(r"#.*", "", head[2:]).split()
    return int(words[2]) if head[:2] in ("P2", "P3", "P5", "P6") and len(words) > 2 and words[2].isdigit() else None


def heif_facts(data: bytes) -> Facts:
    size = int.from_bytes(data[:4], "big")
    brands = [data[i : i + 4] for i in range(8, min(size, len(data)) - 3, 4)] if size >= 16 else []
    return Facts("heif", several=any(b in SEQUENCES for k, b in enumerate(brands) if k != 1))


def bmp_facts(data: bytes) -> Facts:
    read = Reader(data, True)
    bits = read(24 if read(14, 4) == 12 else 28, 2)
    return Facts("bmp", lossless=not (bits is not None and 1 <= bits <= 8))


#: Of each format that `listing.sniff` tells.
FORMATS = {
    "jpeg": jpeg_facts, "png": png_facts, "webp": webp_facts, "ico": ico_facts, "tiff": tiff_facts, "heif": heif_facts, "bmp": bmp_facts,
    "gif": lambda data: Facts("gif", several=gif_frames(data) >= 2), "tga": lambda data: Facts("tga", lossless=data[2:3] not in (b"\x01", b"\x09")),
    "pnm": lambda data: Facts("pnm", lossless=True, deep=(pnm_most(data) or 0) > 255), "qoi": lambda data: Facts("qoi", lossless=True),
    "exr": lambda data: Facts("exr", lossless=True, deep=True), "farbfeld": lambda data: Facts("farbfeld", lossless=True, deep=True),
}


def shown_size(facts: Facts) -> tuple[int | None, int | None]:
    return (facts.height, facts.width) if facts.turned else (facts.width, facts.height)


COLUMNS = "width int, height int, turned boolean, damaged boolean, exif boolean, several boolean, lossless boolean, deep boolean, profile boolean, coding string"


def header_facts(files: DataFrame, id_col: str, format_col: str = "format", content_col: str = "content") -> DataFrame:
    """A row a file: id, format, the shown size where the header tells it, and the facts; a file without a format, or of one that has no facts here, has nulls."""
    rows = files.select(files[id_col].alias("id"), files[format_col].alias("format"), files[content_col].alias("content"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            found = []
            for kind, content in zip(batch.column("format").to_pylist(), batch.column("content"), strict=True):
                made = FORMATS[kind](content.as_py()) if kind in FORMATS and content.is_valid else None
                found.append(None if made is None else asdict(made) | dict(zip(("width", "height"), shown_size(made), strict=True)))
            columns = [pa.array([None if f is None else f[c] for f in found], types[spec.split()[1]]) for c, spec in zip(names, COLUMNS.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("format"), *columns], ["id", "format", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, format string, {COLUMNS}").withColumnRenamed("id", id_col)
