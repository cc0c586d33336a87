"""Units, colours and display values as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions.text import let

# Micrometers in a unit; an unknown unit counts as micrometers.
MICROMETERS = {"nm": 1e-3, "µm": 1.0, "um": 1.0, "micrometer": 1.0, "micron": 1.0, "mm": 1e3, "millimeter": 1e3, "cm": 1e4, "centimeter": 1e4, "m": 1e6, "meter": 1e6}


def micrometers(value: Column, unit: Column) -> Column:
    factor = F.lit(1.0)
    for name, size in MICROMETERS.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    return value * factor


def rational(a: Column, b: Column) -> Column:
    return F.when(a == b, a.cast("double")).otherwise(a / b)


def rgba(value: Column) -> Column:
    """A signed 32-bit colour as red, green, blue and alpha from 0 to 1; alpha 0 means opaque."""
    part = [F.shiftrightunsigned(value.cast("int"), s).bitwiseAND(255) / 255.0 for s in (24, 16, 8, 0)]
    return F.array(*part[:3], F.when(part[3] == 0, 1.0).otherwise(part[3]))


def rgba_int(color: Column) -> Column:
    parts = [F.shiftleft((color[i] * 255).cast("long"), s) for i, s in enumerate((24, 16, 8, 0))]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def hex_rgb(color: Column) -> Column:
    return F.concat(*(F.lpad(F.hex((color[i] * 255).cast("int")), 2, "0") for i in range(3)))


def from_hex(text: Column) -> Column:
    return F.array(*(F.conv(F.substring(text, 1 + 2 * i, 2), 16, 10).cast("double") / 255 for i in range(3)), F.lit(1.0))


def grade(value: Column) -> Column:
    """The colour name of a quality."""
    return F.when(value > 0.5, "green").when(value > 0.25, "gold").when(value > 0.1, "orange").otherwise("red")


# The colours from red over yellow to green that qualities are shown in, evenly spaced.
RED_YELLOW_GREEN = ((165, 0, 38), (215, 48, 39), (244, 109, 67), (253, 174, 97), (254, 224, 139), (255, 255, 191), (217, 239, 139), (166, 217, 106), (102, 189, 99), (26, 152, 80), (0, 104, 55))
# Parts of red, green and blue in lightness.
LIGHT = (0.2125, 0.7154, 0.0721)
# Image modes of a common imaging library with their type and bits; others are 8-bit.
MODES = {"I": ("uint32", 32), "F": ("float32", 32), "RGB": ("uint8", 24), "RGBA": ("uint8", 32), "CMYK": ("uint8", 32), "YCbCr": ("uint8", 24), "LAB": ("uint8", 24), "HSV": ("uint8", 24)}


def quality_rgb(value: Column, least: float = 0.0, most: float = 1.0, span: float = 1.0) -> Column:
    """Red, green and blue of a quality from 0 to 1, of 256 steps of the scale, no darker or lighter than allowed; null is black."""
    anchors = [F.array(*(F.lit(c[i] / 255.0) for c in RED_YELLOW_GREEN)) for i in range(3)]
    step = F.greatest(F.least(F.floor(value * 256), F.lit(255)), F.lit(0)) / 255.0 * (len(RED_YELLOW_GREEN) - 1)

    def between(x: Column) -> Column:
        low = F.least(F.floor(x), F.lit(len(RED_YELLOW_GREEN) - 2)).cast("int")
        return F.array(*(F.get(scale, low) + (F.get(scale, low + 1) - F.get(scale, low)) * (x - low) for scale in anchors))

    def limited(rgb: Column) -> Column:
        return let(sum(part * rgb[i] for i, part in enumerate(LIGHT)), lambda light: F.transform(rgb, lambda c: (F.when(light < least, 1 - (1 - c) * light / (least or 1.0)).when(light > most, c * most / light).otherwise(c)) * span))

    return F.when(value.isNull() | F.isnan(value), F.array(*(F.lit(0.0) for _ in range(3)))).otherwise(let(let(step, between), limited))


def mode_type(mode: Column) -> Column:
    """(dtype, bits) of an image mode."""
    dtype, bits = F.lit("uint8"), F.lit(8)
    for name, (kind, size) in MODES.items():
        dtype, bits = F.when(mode == name, kind).otherwise(dtype), F.when(mode == name, size).otherwise(bits)
    for part, kind in (("32", "uint32"), ("16", "uint16")):
        dtype, bits = F.when(F.contains(mode, F.lit(part)), kind).otherwise(dtype), F.when(F.contains(mode, F.lit(part)), int(part)).otherwise(bits)
    return F.struct(dtype.alias("dtype"), bits.alias("bits"))


def unsigned_type(dtype: Column) -> Column:
    """The name of the unsigned type of an integer type's size, without a byte order."""
    plain = F.regexp_replace(dtype, "^[<>|=]", "")
    return F.when(plain.rlike("^int"), F.concat(F.lit("u"), plain)).otherwise(plain)
