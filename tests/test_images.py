import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions.metadata import image_facts, image_facts_column, metadata_score, metadata_signals
from foliospark.sources.images import read_images, read_pixels


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pixels, exif=b""):
    h, w, n = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(tags, order="<"):
    """A TIFF block of text and rational tags."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    entries, far = b"", b""
    start = 8 + 2 + 12 * len(tags) + 4
    for tag, value in sorted(tags.items()):
        kind, count, data = (2, len(value) + 1, value.encode() + b"\0") if isinstance(value, str) else (5, 1, struct.pack(order + "II", *value))
        if len(data) <= 4:
            entries += struct.pack(order + "HHI", tag, kind, count) + data.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "HHII", tag, kind, count, start + len(far))
            far += data
    return head + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + far


def jpeg(width, height, exif=b""):
    app = b"" if not exif else b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif
    frame = struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9)
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + app + b"\xff\xc4" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + frame + b"\xff\xda" + struct.pack(">H", 2) + b"\xff\xd9"


TAGS = {0x0131: " Adobe Photoshop 2024 ", 0x010F: "ACME", 0x0110: "X1", 0x9003: "2024:01:02 03:04:05", 0x011A: (300, 1)}


@pytest.mark.parametrize("order", ["<", ">"])
def test_facts_from_headers(order):
    want = ("Adobe Photoshop 2024", "ACME", "X1", "2024:01:02 03:04:05", 300.0)
    assert image_facts(jpeg(640, 480, tiff(TAGS, order))) == ("JPEG", 640, 480, True, *want)
    assert image_facts(png(np.zeros((2, 5, 3), np.uint8), tiff(TAGS, order))) == ("PNG", 5, 2, True, *want)
    # A resolution of zero gives way to the other one.
    assert image_facts(jpeg(9, 8, tiff({0x011A: (0, 1), 0x011B: (72, 1), 0x010F: "ab"}, order))) == ("JPEG", 9, 8, True, "", "ab", "", "", 72.0)


def test_broken_headers():
    none = ("JPEG", 9, 8, False, "", "", "", "", None)
    assert image_facts(jpeg(9, 8)) == image_facts(jpeg(9, 8, b"junk!")) == image_facts(jpeg(9, 8, tiff(TAGS)[:30])) == none
    for data in (None, b"", b"GIF89a", b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xc0\0"):
        assert image_facts(data) == (None,) * 9
    whole = jpeg(640, 480, tiff(TAGS))
    for k in range(len(whole)):
        image_facts(whole[:k])


def test_files_to_pixels_and_signals(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {"a b+c.png": rng.integers(0, 256, (7, 5, 3), np.uint8), "grey.png": rng.integers(0, 256, (4, 6, 1), np.uint8), "alpha.png": rng.integers(1, 256, (3, 3, 4), np.uint8)}
    for name, pixels in images.items():
        (tmp_path / name).write_bytes(png(pixels, tiff(TAGS) if name == "grey.png" else b""))
    (tmp_path / "broken.png").write_bytes(b"no image")
    files = read_images(spark, str(tmp_path))
    got = {r.file_name: r for r in files.join(read_pixels(spark, str(tmp_path)), "doc_id").collect()}
    assert sorted(got) == sorted(images)
    for name, pixels in images.items():
        want = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[:, :, :3]
        assert (got[name].height, got[name].width) == want.shape[:2] and bytes(got[name].rgb) == want.tobytes()

    facts = files.withColumn("f", image_facts_column(F.col("content")))
    score = metadata_score(F.col("f.has_exif"), F.col("f.software"), F.col("f.dpi"), F.col("length"), F.col("f.width"), F.col("f.height"), F.col("f.format"))
    said = {r.file_name: r for r in facts.select("file_name", score.alias("score"), metadata_signals(F.col("f"), F.col("length")).alias("s")).collect()}
    assert (said["grey.png"].score, said["grey.png"].s) == (4, ["El campo Software indica edición: Adobe Photoshop 2024.", "Dispositivo registrado: ACME X1", "Fecha EXIF original: 2024:01:02 03:04:05.", "Archivo muy pequeño para un recibo habitual.", "Resolución baja: 6x4."])
    assert (said["alpha.png"].score, said["alpha.png"].s) == (4, ["La imagen no contiene metadatos EXIF útiles.", "No se encontró resolución EXIF (DPI).", "Archivo muy pequeño para un recibo habitual.", "Resolución baja: 3x3."])
    assert said["broken.png"].s == []
