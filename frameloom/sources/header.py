"""Width, height and format of JPEG, PNG and WebP files from their bytes, without decoding."""

from __future__ import annotations

import struct


class Unreadable(ValueError):
    """The bytes are no image of a known format, or end too early."""


def _png(data: bytes) -> tuple[int, int]:
    if data[12:16] != b"IHDR":
        raise Unreadable("no image header in the PNG file")
    return struct.unpack(">II", data[16:24])


def jpeg_segments(data: bytes):
    """(marker, start, end) of each segment's payload up to the first scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unreadable("damaged JPEG segment")
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        if marker == 0xD8 or marker == 0x01 or 0xD0 <= marker <= 0xD7:  # markers that stand alone
            at += 2
            continue
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, at + 4, at + 2 + length
        if marker == 0xDA:
            return
        at += 2 + length


def _jpeg(data: bytes) -> tuple[int, int]:
    for marker, start, end in jpeg_segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if end > len(data):
                break
            height, width = struct.unpack(">HH", data[start + 1 : start + 5])
            return width, height
    raise Unreadable("no frame header in the JPEG file")


def _webp(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    raise Unreadable("no known frame in the WebP file")


def sniff(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return None


def read_header(data: bytes | None) -> tuple[int, int, str]:
    """(width, height, format); raises Unreadable."""
    kind = sniff(data or b"")
    if kind is None:
        raise Unreadable("no JPEG, PNG or WebP file")
    try:
        width, height = {"jpeg": _jpeg, "png": _png, "webp": _webp}[kind](data)
    except (struct.error, IndexError) as e:
        raise Unreadable(f"the {kind} file ends too early") from e
    return width, height, kind
