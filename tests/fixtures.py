"""Image files made in the test: PNG by hand, JPEG by the JVM's writer on the driver, EXIF blocks by hand."""

import struct
import zlib

import numpy as np


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def jpeg(spark, rgb: np.ndarray, path: str, quality: float = 0.9) -> bytes:
    jvm = spark.sparkContext._jvm
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    flat = (rgb[..., 0].astype(int) << 16 | rgb[..., 1].astype(int) << 8 | rgb[..., 2].astype(int)).ravel()
    row = spark.sparkContext._gateway.new_array(jvm.int, len(flat))
    if len(set(flat.tolist())) == 1:
        jvm.java.util.Arrays.fill(row, int(flat[0]))
    else:
        for i, v in enumerate(flat.tolist()):
            row[i] = v
    image.setRGB(0, 0, w, h, row, 0, w)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    writer.dispose()
    with open(path, "rb") as f:
        return f.read()


def solid(width: int, height: int, *rgb: int) -> np.ndarray:
    return np.tile(np.array(rgb, np.uint8), (height, width, 1))


def exif_block(order: str = "<", **tags) -> bytes:
    """A TIFF block with make, model, software, captured_at and latitude as given."""
    number = {"make": 0x010F, "model": 0x0110, "software": 0x0131}
    main = [(number[k], v) for k, v in tags.items() if k in number]
    extra = b""
    count = len(main) + ("captured_at" in tags) + ("latitude" in tags)
    start = 8 + 2 + 12 * count + 4
    entries = []
    for tag, text in sorted(main):
        body = text.encode() + b"\0"
        body += b"\0" * max(0, 5 - len(body))
        entries.append(struct.pack(order + "HHII", tag, 2, len(body), start + len(extra)))
        extra += body
    if "captured_at" in tags:
        at, body = start + len(extra), tags["captured_at"].encode() + b"\0"
        entries.append(struct.pack(order + "HHII", 0x8769, 4, 1, at))
        extra += struct.pack(order + "HHHIII", 1, 0x9003, 2, len(body), at + 18, 0) + body
    if "latitude" in tags:
        at = start + len(extra)
        entries.append(struct.pack(order + "HHII", 0x8825, 4, 1, at))
        d = tags["latitude"]
        ref = b"S\0\0\0" if d < 0 else b"N\0\0\0"
        extra += struct.pack(order + "HHHI", 2, 1, 2, 2) + ref + struct.pack(order + "HHIII", 2, 5, 3, at + 30, 0)
        extra += struct.pack(order + "6I", int(abs(d)), 1, 0, 1, 0, 1)
    entries.sort(key=lambda e: struct.unpack(order + "H", e[:2]))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", count) + b"".join(entries) + struct.pack(order + "I", 0) + extra


def with_exif(data: bytes, block: bytes) -> bytes:
    body = b"Exif\0\0" + block
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]


def webp(width: int, height: int) -> bytes:
    body = b"VP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
