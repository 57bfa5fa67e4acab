"""The few camera tags the checks need, from the TIFF block of a JPEG, PNG or WebP file. Damage means no tags."""

from __future__ import annotations

import struct

from frameloom.sources.header import jpeg_segments, sniff

# Tag numbers of the public EXIF standard.
MAKE, MODEL, SOFTWARE, EXIF_IFD, GPS_IFD, ORIGINAL_TIME, GPS_LAT_REF, GPS_LAT = 0x010F, 0x0110, 0x0131, 0x8769, 0x8825, 0x9003, 1, 2
# Bytes for each TIFF value type.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
EMPTY = {"make": None, "model": None, "captured_at": None, "gps_latitude": None, "software": None, "tag_count": 0}


def tiff_block(data: bytes) -> bytes | None:
    kind = sniff(data)
    if kind == "jpeg":
        for marker, start, end in jpeg_segments(data):
            if marker == 0xE1 and data[start : start + 6] == b"Exif\0\0":
                return data[start + 6 : end]
    elif kind == "png":
        at = 8
        while at + 8 <= len(data):
            length, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            if name == b"eXIf":
                return data[at + 8 : at + 8 + length]
            at += 12 + length
    elif kind == "webp":
        at = 12
        while at + 8 <= len(data):
            name, length = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"EXIF":
                block = data[at + 8 : at + 8 + length]
                return block[6:] if block[:6] == b"Exif\0\0" else block
            at += 8 + length + length % 2
    return None


class _Tiff:
    def __init__(self, block: bytes):
        self.block = block
        self.order = {b"II": "<", b"MM": ">"}[block[:2]]
        if self.unpack("H", 2)[0] != 42:
            raise ValueError("no TIFF block")

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack_from(self.order + form, self.block, at)

    def tags(self, at: int) -> dict[int, object]:
        found = {}
        for i in range(self.unpack("H", at)[0]):
            tag, kind, count = self.unpack("HHI", at + 2 + 12 * i)
            size = TYPE_SIZE.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else self.unpack("I", at + 10 + 12 * i)[0]
            found[tag] = self.value(kind, count, place)
        return found

    def value(self, kind: int, count: int, at: int):
        if kind == 2:
            if at + count > len(self.block):
                raise ValueError("text outside of the block")
            return self.block[at : at + count].split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            parts = self.unpack(("I" if kind == 5 else "i") * 2 * count, at)
            return [n / d if d else 0.0 for n, d in zip(parts[::2], parts[1::2])]
        form = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
        if form is None:
            return None
        held = self.unpack(form * count, at)
        return held[0] if count == 1 else list(held)


def read_exif(data: bytes | None) -> dict:
    """The tags by name; nothing found or any damage gives ``EMPTY``."""
    try:
        block = tiff_block(data or b"")
        if block is None:
            return dict(EMPTY)
        tiff = _Tiff(block)
        main = tiff.tags(tiff.unpack("I", 4)[0])
        more = tiff.tags(main[EXIF_IFD]) if EXIF_IFD in main else {}
        gps = tiff.tags(main[GPS_IFD]) if GPS_IFD in main else {}
        latitude = None
        if isinstance(gps.get(GPS_LAT), list):
            degrees = (gps[GPS_LAT] + [0.0, 0.0])[:3]
            latitude = (degrees[0] + degrees[1] / 60 + degrees[2] / 3600) * (-1 if gps.get(GPS_LAT_REF) == "S" else 1)
        count = len(main.keys() - {EXIF_IFD, GPS_IFD}) + len(more) + len(gps)
        return {"make": main.get(MAKE), "model": main.get(MODEL), "captured_at": more.get(ORIGINAL_TIME), "gps_latitude": latitude, "software": main.get(SOFTWARE), "tag_count": count}
    except Exception:  # noqa: BLE001 - whatever is wrong with the block, the file has no usable tags
        return dict(EMPTY)
