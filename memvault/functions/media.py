"""Kinds, sizes and durations of attachments, from their first bytes and their names."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: first bytes (hex), mime type, kind
MAGIC = (
    ("89504E470D0A1A0A", "image/png", "image"), ("FFD8FF", "image/jpeg", "image"), ("474946383761", "image/gif", "image"),
    ("474946383961", "image/gif", "image"), ("494433", "audio/mpeg", "audio"), ("4F676753", "audio/ogg", "audio"),
    ("664C6143", "audio/flac", "audio"), ("255044462D", "application/pdf", "document"), ("504B0304", "application/zip", "archive"),
    ("1F8B", "application/gzip", "archive"),
)
# fixed values: extensions, mime type, kind
EXTENSIONS = (
    ("png", "image/png", "image"), ("jpg jpeg", "image/jpeg", "image"), ("gif", "image/gif", "image"), ("webp", "image/webp", "image"),
    ("svg", "image/svg+xml", "image"), ("bmp", "image/bmp", "image"), ("ico", "image/x-icon", "image"),
    ("mp3", "audio/mpeg", "audio"), ("wav", "audio/wav", "audio"), ("ogg opus", "audio/ogg", "audio"), ("flac", "audio/flac", "audio"),
    ("m4a", "audio/mp4", "audio"), ("aac", "audio/aac", "audio"),
    ("mp4 m4v", "video/mp4", "video"), ("webm", "video/webm", "video"), ("mov", "video/quicktime", "video"),
    ("pdf", "application/pdf", "document"), ("md markdown", "text/markdown", "document"), ("txt log", "text/plain", "document"), ("csv", "text/csv", "document"),
    ("json", "application/json", "code"), ("jsonl", "application/x-ndjson", "code"), ("toml", "application/toml", "code"),
    ("yaml yml", "application/yaml", "code"), ("rs", "text/x-rust", "code"), ("py", "text/x-python", "code"), ("js mjs", "text/javascript", "code"),
    ("ts tsx", "text/typescript", "code"), ("go", "text/x-go", "code"), ("c h cpp hpp", "text/x-c", "code"), ("java", "text/x-java", "code"),
    ("sh zsh bash", "text/x-shellscript", "code"), ("sql", "application/sql", "code"), ("html htm", "text/html", "code"), ("css", "text/css", "code"),
    ("zip", "application/zip", "archive"), ("tar", "application/x-tar", "archive"), ("gz tgz", "application/gzip", "archive"),
)


def detected(data: Column, filename: Column) -> Column:
    """struct(mime, kind): by the first bytes, else by the extension, else text if the bytes are UTF-8."""
    head = F.hex(F.substring(data, 1, 16))
    tests = [(head.startswith(sign), mime, kind) for sign, mime, kind in MAGIC[:4]]
    riff = head.startswith("52494646")
    tests += [(riff & (F.substring(head, 17, 8) == "57454250"), "image/webp", "image"), (riff & (F.substring(head, 17, 8) == "57415645"), "audio/wav", "audio")]
    tests += [(head.startswith("494433") | head.rlike("^FF[EF]"), "audio/mpeg", "audio")]
    tests += [(head.startswith(sign), mime, kind) for sign, mime, kind in MAGIC[5:]]
    box = F.substring(head, 9, 8) == "66747970"
    tests += [(box & (F.substring(head, 17, 8) == "4D344120"), "audio/mp4", "audio"), (box & (F.octet_length(data) >= 12), "video/mp4", "video")]
    extension = F.lower(F.regexp_extract(filename, r"[^/]\.([^./]+)$", 1))
    tests += [(extension.isin(*names.split()), mime, kind) for names, mime, kind in EXTENSIONS]
    tests += [(F.is_valid_utf8(data.cast("string")) & (F.octet_length(data) > 0), "text/plain", "document")]
    out = None
    for test, mime, kind in tests:
        value = F.struct(F.lit(mime).alias("mime"), F.lit(kind).alias("kind"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("application/octet-stream").alias("mime"), F.lit("binary").alias("kind")))


def _number(data: Column, at: int, size: int, little: bool) -> Column:
    """An unsigned number of size bytes from byte at (0-based)."""
    whole = F.lit(0).cast("long")
    for k in range(size):
        byte = F.conv(F.hex(F.substring(data, at + 1 + k, 1)), 16, 10).cast("long")
        whole = whole + byte * (256 ** (k if little else size - 1 - k))
    return whole


def _sized(width: Column, height: Column) -> Column:
    """WxH, null unless both are positive."""
    return F.when((width > 0) & (height > 0), F.concat_ws("x", width.cast("string"), height.cast("string")))


def _webp(data: Column) -> Column:
    """WxH of the three kinds of WebP frames, told apart by the first chunk."""
    chunk, length = F.hex(F.substring(data, 13, 4)), F.octet_length(data)
    bits = _number(data, 21, 4, True)
    low = lambda at: _number(data, at, 2, True).bitwiseAND(0x3FFF)
    return (
        F.when((chunk == "56503858") & (length >= 30), _sized(_number(data, 24, 3, True) + 1, _number(data, 27, 3, True) + 1))
        .when((chunk == "56503820") & (length >= 30) & (F.hex(F.substring(data, 24, 3)) == "9D012A"), _sized(low(26), low(28)))
        .when((chunk == "5650384C") & (length >= 25) & (F.hex(F.substring(data, 21, 1)) == "2F"), _sized(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1))
    )


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body with its length) of a JPEG's segments up to its image data."""
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        at += len(data) - at - len(data[at:].lstrip(b"\xff"))
        if at + 3 > len(data) or data[at] in (0xD9, 0xDA):
            return
        marker, size = data[at], int.from_bytes(data[at + 1 : at + 3], "big")
        if size < 2 or at + 1 + size > len(data):
            return
        yield marker, data[at + 1 : at + 1 + size]
        at += 1 + size


def _jpeg(data: bytes) -> dict:
    """The size in the first frame header (SOF0 to SOF3)."""
    for marker, body in _segments(data):
        if 0xC0 <= marker <= 0xC3 and len(body) >= 7:
            height, width = struct.unpack(">HH", body[3:7])
            if width and height:
                return {"dimensions": f"{width}x{height}"}
    return {}


def _boxes(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(type, body) of the boxes of an ISO media file, those in moov and trak included, until one is damaged."""
    at = 0
    while at + 8 <= len(data):
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 0:
            size = len(data) - at
        elif size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        if size < head or at + size > len(data):
            return
        kind, body = bytes(data[at + 4 : at + 8]), data[at + head : at + size]
        if kind in (b"moov", b"trak"):
            yield from _boxes(body)
        else:
            yield kind, body
        at += size


#: By version: the shortest header, where its time scale and its duration lie.
MVHD = {0: (20, ">12xII"), 1: (32, ">20xIQ")}
#: By version: where width and height of a track lie, as 16.16 numbers.
TKHD = {0: (84, ">76xII"), 1: (96, ">88xII")}


def _mp4(data: bytes) -> dict:
    """The first positive track size and the first positive duration."""
    found = {}
    for kind, body in _boxes(memoryview(data)):
        table = {b"mvhd": MVHD, b"tkhd": TKHD}.get(kind, {})
        least, layout = table.get(body[0], (0, "")) if len(body) else (0, "")
        if not least or len(body) < least:
            continue
        one, two = struct.unpack_from(layout, body)
        if kind == b"mvhd" and one and two:
            found.setdefault("seconds", two / one)
        elif kind == b"tkhd" and one >> 16 and two >> 16:
            found.setdefault("dimensions", f"{one >> 16}x{two >> 16}")
    return found


def _wav(data: bytes) -> dict:
    """Bytes of the data chunk over bytes a second; chunks before it are passed over."""
    at, rate = 12, 0
    while len(data) >= 44 and at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"data":
            return {"seconds": size / rate} if rate and size else {}
        if name == b"fmt " and at + 20 <= len(data):
            rate = int.from_bytes(data[at + 16 : at + 20], "little")
        at += 8 + size + size % 2
    return {}


#: Types whose headers must be walked through.
WALKED = {"image/jpeg": _jpeg, "video/mp4": _mp4, "video/quicktime": _mp4, "audio/mp4": _mp4, "audio/wav": _wav}


def _walked(data: Column, mime: Column) -> Column:
    """struct(dimensions, seconds) of files that must be walked through; others don't reach Python."""
    fields = pa.struct([("dimensions", pa.string()), ("seconds", pa.float64())])

    def read(files: pa.Array, kinds: pa.Array) -> pa.Array:
        pairs = zip(files.to_pylist(), kinds.to_pylist(), strict=True)
        return pa.array([None if f is None or k not in WALKED else {"dimensions": None, "seconds": None} | WALKED[k](f) for f, k in pairs], fields)

    return F.arrow_udf(read, "dimensions string, seconds double")(F.when(mime.isin(*WALKED), data), mime)


def dimensions(data: Column, mime: Column) -> Column:
    """WxH of PNG, GIF, WebP, JPEG and MP4; null for other types and for damaged headers."""
    png = _sized(_number(data, 16, 4, False), _number(data, 20, 4, False))
    gif = _sized(_number(data, 6, 2, True), _number(data, 8, 2, True))
    return (
        F.when((mime == "image/png") & (F.octet_length(data) >= 24) & (F.hex(F.substring(data, 13, 4)) == "49484452"), png)
        .when((mime == "image/gif") & (F.octet_length(data) >= 10), gif)
        .when(mime == "image/webp", _webp(data))
        .otherwise(_walked(data, mime)["dimensions"])
    )


def seconds(data: Column, mime: Column) -> Column:
    """Seconds of WAV and MP4."""
    return _walked(data, mime)["seconds"]
