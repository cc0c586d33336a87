"""TIFF and OME-TIFF images: headers as rows, segments (tiles or strips) read and decoded one by one, and a writer with pyramids.

Classic and big TIFF of either byte order; samples of 8 to 64 bits; without compression, LZW or deflate, with or without
horizontal differences. A header is read by seeks, never with its pixels. What one task holds is a segment. Paths
are URIs or local paths of a store that all executors see.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import units
from weftwork.sources import store

# Fixed values of the format: sizes and codes of field types; numbers of the tags that are read or written.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
TAGS = {
    254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "Photometric", 270: "ImageDescription", 273: "StripOffsets", 277: "SamplesPerPixel",
    278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 296: "ResolutionUnit", 305: "Software", 317: "Predictor", 322: "TileWidth", 323: "TileLength",
    324: "TileOffsets", 325: "TileByteCounts", 330: "SubIFDs", 339: "SampleFormat",
}
KINDS = {1: "u", 2: "i", 3: "f"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def _directory(file: BinaryIO, order: str, big: bool, at: int) -> tuple[dict[int, Any], int]:
    """The tags of the directory at a place, and the place of the next."""
    file.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
    size = 20 if big else 12
    entries = file.read(n * size)
    following = struct.unpack(order + ("Q" if big else "I"), file.read(8 if big else 4))[0]
    tags: dict[int, Any] = {}
    for k in range(n):
        entry = entries[k * size : (k + 1) * size]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 12 if big else 8])[0]
        if kind not in TYPES:
            continue
        width, code = TYPES[kind]
        raw = entry[12 if big else 8 :]
        if width * count > len(raw):
            file.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
            raw = file.read(width * count)
        if code == "s":
            tags[tag] = raw[:count].rstrip(b"\0").decode("utf-8", "replace")
        else:
            values = struct.unpack(order + code * count, raw[: width * count])
            tags[tag] = tuple(zip(values[::2], values[1::2], strict=True)) if len(code) == 2 else values
    return tags, following


def directories(file: BinaryIO) -> tuple[str, list[dict[int, Any]]]:
    """The byte order and the tags of all pages, each page followed by its smaller levels under the tag 330."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at, out, seen = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0], [], set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(file, order, big, at)
        tags["levels"] = [_directory(file, order, big, x)[0] for x in tags.get(330, ())]
        out.append(tags)
    return order, out


def described(tags: dict[int, Any]) -> dict[str, Any]:
    """Tags by their names."""
    return {TAGS.get(k, str(k)): v[0] if isinstance(v, tuple) and len(v) == 1 else v for k, v in tags.items() if k != "levels"}


def _dtype(tags: dict[int, Any]) -> str:
    bits = tags.get(258, (1,))[0]
    return np.dtype(f"{KINDS.get(tags.get(339, (1,))[0], 'u')}{max(bits, 8) // 8}").name


def _level(tags: dict[int, Any]) -> dict[str, Any]:
    width, height, samples = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    tiled = 322 in tags
    seg_w, seg_h = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height))
    return {
        "height": height, "width": width, "samples": samples, "seg_h": seg_h, "seg_w": seg_w, "planar": tags.get(284, (1,))[0] == 2, "compression": tags.get(259, (1,))[0], "predictor": tags.get(317, (1,))[0],
        "offsets": list(tags[324 if tiled else 273]), "counts": list(tags[325 if tiled else 279]), "dtype": _dtype(tags),
    }


_OME = "{*}"


def ome(xml: str, uuid: str | None = None) -> dict[str, Any]:
    """Pixel sizes and position in micrometers, rotation in degrees, channels and order of axes of an image in OME-XML (the one whose file has a UUID, or the first)."""
    root = ElementTree.fromstring(xml.encode())
    found = root.findall(f"{_OME}Image")
    if uuid is not None:
        found = [i for i in found if any((u.text or "").strip() == uuid for u in i.iter() if u.tag.endswith("UUID"))]
    out: dict[str, Any] = {"pixel": {}, "position": {}, "rotation": None, "channels": [], "order": ""}
    if not found:
        return out
    pixels = found[0].find(f"{_OME}Pixels")
    if pixels is None:
        return out

    def micrometers(value: str, unit: str | None) -> float:
        return float(value) * units.MICROMETERS.get(unit or "µm", 1.0)

    out["order"] = pixels.get("DimensionOrder", "")
    out["sizes"] = {d.lower(): int(pixels.get(f"Size{d}", 1)) for d in "XYZCT"}
    for d in "XYZ":
        if float(pixels.get(f"PhysicalSize{d}", 0)):
            out["pixel"][d.lower()] = micrometers(pixels.get(f"PhysicalSize{d}"), pixels.get(f"PhysicalSize{d}Unit"))
    for plane in pixels.findall(f"{_OME}Plane"):
        for d in "XYZ":
            if plane.get(f"Position{d}") is not None:
                out["position"][d.lower()] = micrometers(plane.get(f"Position{d}"), plane.get(f"Position{d}Unit"))
    for channel in pixels.findall(f"{_OME}Channel"):
        out["channels"].append({"label": channel.get("Name", ""), "color": int(channel.get("Color")) if channel.get("Color") else None})
    for value in (v for a in root.findall(f"{_OME}StructuredAnnotations") for v in a.iter() if v.tag.endswith("Value")):
        text, unit = None, ""
        if value.text and value.text.strip().lower().startswith("angle"):
            parts = value.text.strip()[5:].lstrip(" :=").split()
            text, unit = (parts[0] if parts else None), parts[1] if len(parts) > 1 else ""
        for modulo in (m for m in value.iter() if m.tag.endswith("ModuloAlongZ")):
            label = next((x.text for x in modulo.iter() if x.tag.endswith("Label")), None) or modulo.get("Label")
            text, unit = label, modulo.get("Unit", "")
        if text is not None:
            out["rotation"] = float(np.degrees(float(text))) if "rad" in unit.lower() else float(text)
    return out


_HEADER = pa.schema([
    ("path", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("order", pa.string()), ("height", pa.int64()), ("width", pa.int64()), ("samples", pa.int32()), ("dtype", pa.string()), ("is_rgb", pa.bool_()),
    ("seg_h", pa.int64()), ("seg_w", pa.int64()), ("planar", pa.bool_()), ("compression", pa.int32()), ("predictor", pa.int32()), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("pixel", pa.map_(pa.string(), pa.float64())), ("position", pa.map_(pa.string(), pa.float64())), ("rotation", pa.float64()), ("channels", pa.list_(pa.struct([("label", pa.string()), ("color", pa.int64())]))), ("tags", pa.map_(pa.string(), pa.string())),
])
_HEADER_DDL = "path string, page int, level int, order string, height long, width long, samples int, dtype string, is_rgb boolean, seg_h long, seg_w long, planar boolean, compression int, predictor int, offsets array<long>, counts array<long>, pixel map<string, double>, position map<string, double>, rotation double, channels array<struct<label: string, color: long>>, tags map<string, string>"


def header_rows(path: str) -> list[dict[str, Any]]:
    """The rows of one file's pages and levels."""
    with store.reading(path) as file:
        order, pages = directories(file)
    text = pages[0].get(270, "")
    meta = {"pixel": {}, "position": {}, "rotation": None, "channels": []}
    if "<OME" in text[:400]:
        root = ElementTree.fromstring(text.encode())
        companion = root.find(f"{_OME}BinaryOnly")
        if companion is not None:
            with store.reading(f"{path.rpartition('/')[0]}/{companion.get('MetadataFile')}") as file:
                meta = ome(file.read().decode("utf-8"), root.get("UUID"))
        else:
            meta = ome(text)
    rows = []
    for page, tags in enumerate(pages):
        rgb = tags.get(262, (1,))[0] in (2, 3) and tags.get(277, (1,))[0] in (3, 4)
        for level, own in enumerate([tags, *tags["levels"]]):
            names = {k: str(v) for k, v in described(own).items() if not k.endswith(("Offsets", "ByteCounts"))}
            rows.append({"path": path, "page": page, "level": level, "order": order, "is_rgb": rgb, "pixel": list(meta["pixel"].items()), "position": list(meta["position"].items()), "rotation": meta["rotation"], "channels": meta["channels"], "tags": list(names.items()), **_level(own)})
    return rows


def headers(paths: DataFrame) -> DataFrame:
    """One row for each page and level of the files of ``paths`` (path): sizes, type, segments, OME metadata, tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(header_rows(path), schema=_HEADER)

    return paths.select("path").mapInArrow(run, _HEADER_DDL)


def _unlzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, that grow one code early."""
    out, table, width, bits, n, last = bytearray(), [], 9, 0, 0, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code = bits >> n & ((1 << width) - 1)
        bits &= (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = base[:], 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    out, bits, n, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
            bits &= (1 << n) - 1

    put(256)
    table, following, have = {bytes([i]): i for i in range(256)}, 258, b""
    for i in range(len(data)):
        more = have + data[i : i + 1]
        if more in table:
            have = more
            continue
        put(table[have])
        table[more] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following >= 4094:
            put(256)
            table, following, width = {bytes([k]): k for k in range(256)}, 258, 9
        have = data[i : i + 1]
    if have:
        put(table[have])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def decoded(data: bytes, row: dict[str, Any]) -> np.ndarray:
    """A segment's samples (row, column, sample); one of planar images has one sample."""
    if row["compression"] in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif row["compression"] == LZW:
        data = _unlzw(data)
    elif row["compression"] != NONE:
        raise ValueError(f"unknown compression {row['compression']}")
    kind, samples = np.dtype(row["dtype"]).newbyteorder(row["order"]), 1 if row["planar"] else row["samples"]
    line = row["seg_w"] * samples
    whole = np.frombuffer(data, kind)[: len(data) // kind.itemsize // line * line].reshape(-1, row["seg_w"], samples)
    if row["predictor"] == 2:
        whole = np.cumsum(whole.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    return whole


def segments(header: DataFrame, level: int | None = 0) -> DataFrame:
    """One row for each segment of a level, or of all: what its task must read, and where its pixels are."""
    rows = header if level is None or level < 0 else header.where(F.col("level") == level)
    rows = rows.select("*", F.posexplode("offsets").alias("n", "offset")).withColumn("count", F.element_at("counts", F.col("n") + 1))
    across, down = F.ceil(F.col("width") / F.col("seg_w")), F.ceil(F.col("height") / F.col("seg_h"))
    return rows.drop("offsets", "counts", "pixel", "position", "channels", "tags").withColumns({"plane": F.floor(F.col("n") / (across * down)), "y0": F.floor(F.col("n") % (across * down) / across) * F.col("seg_h"), "x0": F.col("n") % across * F.col("seg_w")})


def pixels(segment_rows: DataFrame) -> DataFrame:
    """(path, page, level, c, y, x, value) of segments; each is read by itself."""
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("c", pa.int32()), ("y", pa.int64()), ("x", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with store.reading(row["path"]) as file:
                    file.seek(row["offset"])
                    block = decoded(file.read(row["count"]), row)
                block = block[: row["height"] - row["y0"], : row["width"] - row["x0"]]
                y, x, c = (i.ravel() for i in np.indices(block.shape))
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * n, pa.string()), pa.array(np.full(n, row["page"], np.int32)), pa.array(np.full(n, row["level"], np.int32)), pa.array((c + row["plane"]).astype(np.int32)), pa.array(y + row["y0"]), pa.array(x + row["x0"]), pa.array(block.ravel().astype(float))], schema=schema)

    return segment_rows.mapInArrow(run, "path string, page int, level int, c int, y long, x long, value double")


def metadata(shape: tuple[int, ...], dtype: str, pixel: dict[str, float], position: dict[str, float] | None = None, rotation: float | None = None, channels: list[dict[str, Any]] | None = None, name: str = "") -> str:
    """OME-XML of one image of a shape (channels, height, width)."""
    n, height, width = shape
    root = ElementTree.Element("OME", {"xmlns": "http://www.openmicroscopy.org/Schemas/OME/2016-06"})
    image = ElementTree.SubElement(root, "Image", {"ID": "Image:0", "Name": name})
    kind = {"float32": "float", "float64": "double"}.get(dtype, dtype)
    sizes = {f"PhysicalSize{d.upper()}": repr(float(v)) for d, v in pixel.items()} | {f"PhysicalSize{d.upper()}Unit": "µm" for d in pixel}
    pixels_ = ElementTree.SubElement(image, "Pixels", {"ID": "Pixels:0", "DimensionOrder": "XYCZT", "Type": kind, "SizeX": str(width), "SizeY": str(height), "SizeC": str(n), "SizeZ": "1", "SizeT": "1", **sizes})
    for c in range(n):
        own = (channels or [])[c] if c < len(channels or []) else {}
        more = {"Color": str(own["color"])} if own.get("color") is not None else {}
        ElementTree.SubElement(pixels_, "Channel", {"ID": f"Channel:0:{c}", "Name": own.get("label", ""), "SamplesPerPixel": "1", **more})
    for c in range(n):
        ElementTree.SubElement(pixels_, "TiffData", {"FirstC": str(c), "IFD": str(c), "PlaneCount": "1"})
    for c in range(n if position else 0):
        at = {f"Position{d.upper()}": repr(float(v)) for d, v in position.items()} | {f"Position{d.upper()}Unit": "µm" for d in position}
        ElementTree.SubElement(pixels_, "Plane", {"TheC": str(c), "TheZ": "0", "TheT": "0", **at})
    if rotation is not None:
        annotation = ElementTree.SubElement(ElementTree.SubElement(root, "StructuredAnnotations"), "CommentAnnotation", {"ID": "Annotation:0"})
        ElementTree.SubElement(annotation, "Value").text = f"Angle: {rotation} degrees"
    return ElementTree.tostring(root, encoding="unicode")


def encoded(planes: list[list[np.ndarray]], description: str = "", pixel: tuple[float, float] | None = None, tile: int | None = 256, compression: str = "deflate") -> bytes:
    """A file of pages, each a list of levels (height, width): a page's smaller levels are under its tag 330.

    Big TIFF where the samples come to 4 GB or near. Tiles larger than an image give way to one strip.
    """
    codes = {"": NONE, "none": NONE, "lzw": LZW, "deflate": DEFLATE, "zlib": DEFLATE}
    if (compression or "").lower() not in codes:
        raise ValueError(f"unknown compression {compression}")
    code = codes[(compression or "").lower()]
    big = sum(level.nbytes for page in planes for level in page) > (1 << 32) - (1 << 26)
    word, out = "Q" if big else "I", bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
    link = 8 if big else 4

    def add(data: bytes) -> int:
        if len(out) % 2:
            out.append(0)
        at = len(out)
        out.extend(data)
        return at

    def directory(level: np.ndarray, text: str, smaller: list[int], reduced: bool) -> tuple[int, int]:
        height, width = level.shape
        side = tile if tile and tile <= min(height, width) else None
        places = [(y, x) for y in range(0, height, side) for x in range(0, width, side)] if side else [(0, 0)]
        offsets, counts = [], []
        for y, x in places:
            block = level
            if side:
                block = np.zeros((side, side), level.dtype)
                part = level[y : y + side, x : x + side]
                block[: part.shape[0], : part.shape[1]] = part
            data = np.ascontiguousarray(block).astype(level.dtype.newbyteorder("<")).tobytes()
            data = zlib.compress(data) if code == DEFLATE else _lzw(data) if code == LZW else data
            offsets.append(add(data))
            counts.append(len(data))
        kind = {"u": 1, "i": 2, "f": 3}[level.dtype.kind]
        tags: list[tuple[int, int, tuple | bytes]] = [(254, 4, (1 if reduced else 0,)), (256, 4, (width,)), (257, 4, (height,)), (258, 3, (8 * level.dtype.itemsize,)), (259, 3, (code,)), (262, 3, (1,)), (277, 3, (1,)), (284, 3, (1,)), (339, 3, (kind,))]
        if text:
            tags.append((270, 2, text.encode() + b"\0"))
        if pixel:  # pixels for each centimeter
            tags += [(282, 5, (round(1e4 / pixel[0] * 1000), 1000)), (283, 5, (round(1e4 / pixel[1] * 1000), 1000)), (296, 3, (3,))]
        if smaller:
            tags.append((330, 16 if big else 4, tuple(smaller)))
        tags += [(322, 4, (side,)), (323, 4, (side,)), (324, 16 if big else 4, tuple(offsets)), (325, 16 if big else 4, tuple(counts))] if side else [(273, 16 if big else 4, tuple(offsets)), (278, 4, (height,)), (279, 16 if big else 4, tuple(counts))]
        entries = b""
        for tag, type_, value in sorted(tags, key=lambda t: t[0]):
            width_, form = TYPES[type_]
            raw = value if isinstance(value, bytes) else struct.pack("<" + form[0] * len(value), *value)
            n = len(raw) // width_
            entries += struct.pack("<HH" + word, tag, type_, n) + (raw.ljust(link, b"\0") if len(raw) <= link else struct.pack("<" + word, add(raw)))
        at = add(struct.pack("<Q" if big else "<H", len(tags)) + entries + b"\0" * link)
        return at, at + (8 if big else 2) + len(entries)

    before = 8 if big else 4
    for k, page in enumerate(planes):
        smaller = [directory(level, "", [], True)[0] for level in page[1:]]
        at, following = directory(page[0], description if k == 0 else "", smaller, False)
        struct.pack_into("<" + word, out, before, at)
        before = following
    return bytes(out)


def pyramid(plane: np.ndarray, levels: int, factor: int = 2) -> list[np.ndarray]:
    """A plane and its means over squares, level by level, while both sides hold a square."""
    out = [plane]
    for _ in range(levels):
        h, w = (n // factor for n in out[-1].shape)
        if not h or not w:
            break
        mean = out[-1][: h * factor, : w * factor].reshape(h, factor, w, factor).mean(axis=(1, 3))
        out.append((np.round(mean) if plane.dtype.kind in "iu" else mean).astype(plane.dtype))
    return out


def save(pixel_rows: DataFrame, dtype: str, levels: int = 0, tile: int | None = 256, compression: str = "deflate", ome_: bool = True, pixel: float | None = None) -> DataFrame:
    """Writes images of ``pixel_rows`` (path, c, y, x, value, and px, x0, y0 where known) to their paths; gives (path, bytes).

    A group is one image, which one task holds. Places without a value are 0. A file is written under another
    name and then renamed, so a task that runs again leaves a whole file.
    """
    known = {c: c in pixel_rows.columns for c in ("px", "x0", "y0")}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["value"])
        shape = tuple(int(rows[c].max()) + 1 for c in ("c", "y", "x"))
        image = np.zeros(shape, dtype)
        image[tuple(rows[c].to_numpy(int) for c in ("c", "y", "x"))] = rows.value.to_numpy().astype(dtype)
        px = float(rows.px.iloc[0]) if known["px"] else pixel
        at = {d: float(rows[f"{d}0"].iloc[0]) for d in "xy"} if known["x0"] and known["y0"] else None
        text = metadata(shape, dtype, {"x": px, "y": px} if px else {}, at) if ome_ else ""
        data = encoded([pyramid(plane, levels) for plane in image], text, (px, px) if px else None, tile, compression)
        store.written(key[0], data)
        return pd.DataFrame({"path": [key[0]], "bytes": [len(data)]})

    return pixel_rows.groupBy("path").applyInPandas(run, "path string, bytes long")


def load(path: str) -> np.ndarray:
    """A small image's first level at once (page or channel, row, column), on the driver."""
    rows = [r for r in header_rows(path) if r["level"] == 0]
    out = np.zeros((max(len(rows), rows[0]["samples"]), rows[0]["height"], rows[0]["width"]), rows[0]["dtype"])
    with store.reading(path) as file:
        for row in rows:
            across = -(-row["width"] // row["seg_w"])
            each = across * -(-row["height"] // row["seg_h"])
            for n, (offset, count) in enumerate(zip(row["offsets"], row["counts"], strict=True)):
                file.seek(offset)
                block = decoded(file.read(count), row)
                y, x = n % each // across * row["seg_h"], n % across * row["seg_w"]
                block = block[: row["height"] - y, : row["width"] - x]
                for s in range(block.shape[2]):
                    out[row["page"] + s + n // each, y : y + block.shape[0], x : x + block.shape[1]] = block[:, :, s]
    return out
