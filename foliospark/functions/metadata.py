"""File and EXIF facts, their score and what they say."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EDITORS = ("photoshop", "lightroom", "gimp", "canva", "pixlr", "photopea", "snapseed", "affinity")
FORMATS = ("JPEG", "PNG", "WEBP")
LEAST_BYTES, LEAST_SIDE = 20_000, 500
# Tags of the first directory.
SOFTWARE, MAKE, MODEL, TAKEN, X_RESOLUTION, Y_RESOLUTION = 0x0131, 0x010F, 0x0110, 0x9003, 0x011A, 0x011B
# Bytes of a directory entry's types.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
# Wording of the signals.
NO_EXIF, NO_DPI, SMALL = "La imagen no contiene metadatos EXIF útiles.", "No se encontró resolución EXIF (DPI).", "Archivo muy pequeño para un recibo habitual."
EDITED, RECORDED, DEVICE, DATED = "El campo Software indica edición: %s.", "Software registrado: %s.", "Dispositivo registrado: %s %s", "Fecha EXIF original: %s."
LOW_RESOLUTION, UNUSUAL_FORMAT = "Resolución baja: %dx%d.", "Formato poco habitual para un recibo: %s."

FACTS = "format string, width int, height int, has_exif boolean, software string, make string, model string, datetime_original string, dpi double"


def _directory(data: bytes) -> dict[int, object]:
    """Tags of the first directory of a TIFF block: strings, or the first number."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    start = struct.unpack_from(order + "I", data, 4)[0]
    found: dict[int, object] = {}
    for k in range(struct.unpack_from(order + "H", data, start)[0]):
        at = start + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, at)
        size = _SIZES.get(kind, 0) * count
        if not size:
            continue
        place = at + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 8)[0]
        if place + size > len(data):
            continue
        if kind == 2:
            found[tag] = data[place : place + size].split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (5, 10):
            above, below = struct.unpack_from(order + ("II" if kind == 5 else "ii"), data, place)
            found[tag] = above / below if below else float("nan")
        else:
            found[tag] = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}[kind], data, place)[0]
    return found


def _jpeg(data: bytes) -> tuple[int, int, bytes]:
    at, width, height, exif = 2, 0, 0, b""
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:  # padding
            at += 1
            continue
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and not exif:
            exif = data[at + 10 : at + 2 + size]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
        if marker == 0xDA or size < 2:
            break
        at += 2 + size
    return width, height, exif


def _png(data: bytes) -> tuple[int, int, bytes]:
    at, exif = 8, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            exif = data[at + 8 : at + 8 + size]
        at += 12 + size
    return *struct.unpack_from(">II", data, 16), exif


def image_facts(data: bytes | None) -> tuple:
    """FACTS of a file's bytes from its headers alone; no pixel is decoded.

    Null for a file that is neither JPEG nor PNG or whose size can't be read. Broken EXIF counts
    as none. Only the first directory is read; texts are trimmed and empty if absent.
    """
    data = data or b""
    name = "JPEG" if data[:2] == b"\xff\xd8" else "PNG" if data[:8] == b"\x89PNG\r\n\x1a\n" else None
    try:
        width, height, block = {"JPEG": _jpeg, "PNG": _png, None: lambda d: (0, 0, b"")}[name](data)
    except struct.error:
        width, height, block = 0, 0, b""
    if not width or not height:
        return (None,) * 9
    try:
        tags = _directory(block) if block else {}
    except (struct.error, KeyError):
        tags = {}
    text = [str(tags.get(t, "")).strip() for t in (SOFTWARE, MAKE, MODEL, TAKEN)]
    dpi = tags.get(X_RESOLUTION) or tags.get(Y_RESOLUTION)
    return name, width, height, bool(tags), *text, float(dpi) if isinstance(dpi, int | float) else None


def image_facts_column(content: Column) -> Column:
    """``image_facts`` as a struct column, over Arrow batches of file contents."""

    @F.pandas_udf(FACTS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FACTS.split(", ")]
        for batch in batches:
            made = pd.DataFrame([image_facts(b) for b in batch], columns=names)
            yield made.astype({"width": "Int32", "height": "Int32", "has_exif": "boolean", "dpi": "Float64"})

    return read(content)


def _edited(software: Column) -> Column:
    low = F.lower(F.coalesce(software, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in EDITORS))


def metadata_score(has_exif: Column, software: Column, dpi: Column, file_size: Column, width: Column, height: Column, image_format: Column) -> Column:
    """0 to 4: no EXIF 1, editing software 2, no resolution 1, under 20,000 bytes 1, a side under 500 1, another format 1."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    total = one(~has_exif) + 2 * one(_edited(software)) + one(dpi.isNull()) + one(file_size < LEAST_BYTES) + one((width < LEAST_SIDE) | (height < LEAST_SIDE)) + one(~F.coalesce(image_format, F.lit("")).isin(*FORMATS))
    return F.least(F.lit(4), total)


def metadata_signals(facts: Column, file_size: Column) -> Column:
    """What the facts say, in words and in the order in which they are checked; null facts say nothing."""
    f = {name: facts[name] for name in (x.split()[0] for x in FACTS.split(", "))}
    device = F.trim(F.format_string(DEVICE, f["make"], f["model"]))
    lines = [
        F.when(~f["has_exif"], F.lit(NO_EXIF)),
        F.when(f["software"] != "", F.when(_edited(f["software"]), F.format_string(EDITED, f["software"])).otherwise(F.format_string(RECORDED, f["software"]))),
        F.when((f["make"] != "") | (f["model"] != ""), device),
        F.when(f["datetime_original"] != "", F.format_string(DATED, f["datetime_original"])),
        F.when(f["format"].isNotNull() & f["dpi"].isNull(), F.lit(NO_DPI)),
        F.when(f["format"].isNotNull() & (file_size < LEAST_BYTES), F.lit(SMALL)),
        F.when((f["width"] < LEAST_SIDE) | (f["height"] < LEAST_SIDE), F.format_string(LOW_RESOLUTION, f["width"], f["height"])),
        F.when(~f["format"].isin(*FORMATS), F.format_string(UNUSUAL_FORMAT, f["format"])),
    ]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())
