"""Values by dimension: lists with an order such as "zyx", maps from dimension to value, and the lists of channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions.text import fixed, human_bytes


def _dims(dims: str) -> Column:
    return F.array(*(F.lit(d) for d in dims))


def reordered(items: Column, old: str, new: str, default: float = 0) -> Column:
    """Items in the order of other dimensions; one that they lack takes the default."""
    return F.array(*(items[old.index(d)] if d in old else F.lit(default) for d in new))


def by_dim(values: Column, dims: str = "xyz") -> Column:
    """A map from dimension to value; dimensions beyond the values have none."""
    return F.map_from_arrays(F.slice(_dims(dims), F.lit(1), F.least(F.size(values), F.lit(len(dims)))), F.slice(values, 1, len(dims)))


def listed(values: Column, dims: str = "xyz", zeros: bool = False) -> Column:
    """A map's values in the order of dimensions; missing ones are left out, or zeros at the end."""
    found = F.transform(F.filter(_dims(dims), lambda d: F.map_contains_key(values, d)), lambda d: F.element_at(values, d))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0.0), len(dims))), 1, len(dims)) if zeros else found


def to_3d(point: Column) -> Column:
    return F.concat(point, F.array(F.lit(0.0)))


def full_rank(chunks: Column, shape: Column) -> Column:
    """Chunk sizes for all dimensions of a shape; leading ones take the whole shape."""
    return F.concat(F.slice(shape, F.lit(1), F.size(shape) - F.size(chunks)), chunks)


def scaled_shape(shape: Column, dims: str, scale: Column) -> Column:
    """A shape whose x and y are scaled and cut to whole numbers."""
    return F.array(*((shape[i] * scale).cast("long") if d in "xy" else shape[i] for i, d in enumerate(dims)))


def scaled_sizes(sizes: Column, scale: Column) -> Column:
    """The same for a map."""
    return F.transform_values(sizes, lambda d, n: F.when(d.isin("x", "y"), (n * scale).cast("long")).otherwise(n))


def level_pixel_size(pixel: Column, factors: Column) -> Column:
    """The pixel size of a level: the first level's times the level's factors."""
    return F.transform_values(pixel, lambda d, p: p * F.coalesce(F.element_at(factors, d), F.lit(1.0)))


def physical_size(sizes: Column, pixel: Column) -> Column:
    """Size times pixel size; a dimension without a pixel size has one of 1."""
    return F.transform_values(sizes, lambda d, n: n * F.coalesce(F.element_at(pixel, d), F.lit(1.0)))


def n_channels(sizes: Column) -> Column:
    return F.coalesce(F.element_at(sizes, "c").cast("long"), F.lit(1).cast("long"))


def channels_or_unnamed(labels: Column, n: Column, is_rgb: Column) -> Column:
    """Channel labels; without any one empty label for an RGB image, else one for each channel."""
    unnamed = F.array_repeat(F.lit(""), F.when(is_rgb, 1).otherwise(n).cast("int"))
    return F.when(F.size(labels) > 0, labels).otherwise(unnamed)


def labelled(elements: Column, label: Column) -> Column:
    """The first element with a label."""
    return F.get(F.filter(elements, lambda e: e["label"] == label), F.lit(0))


def is_given(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")


def holds(value: Column, part: str, is_map: bool = False) -> Column:
    """Whether a text holds a part, or a map a key; false for null."""
    return F.coalesce(F.map_contains_key(value, part) if is_map else F.contains(value, F.lit(part)), F.lit(False))


def without_nulls(values: Column) -> Column:
    return F.map_filter(values, lambda _, v: v.isNotNull())


def as_list(value: Column) -> Column:
    """No element for null, else one."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def or_default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def updated(values: Column, key: str, value: Column) -> Column:
    """A map with one value set; a text that reads as a number is set as that number."""
    rest = F.map_filter(values, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value.try_cast("double")))


def shown(values: Column) -> Column:
    """"k: v" of each entry of a map of doubles, by key, with three decimals."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(fixed(e["value"], 3), F.lit("null")))), " ")


def shown_dims(values: Column, dims: str = "xyz", decimals: int = 3, bare: bool = False) -> Column:
    """"x:1.000 y:2.000" in the order of dimensions, without those that are missing."""
    number = lambda d: F.coalesce(fixed(F.element_at(values, d), decimals), F.lit("null"))
    parts = F.transform(F.filter(_dims(dims), lambda d: F.map_contains_key(values, d)), lambda d: number(d) if bare else F.concat(d, F.lit(":"), number(d)))
    return F.array_join(parts, " ")


def shown_tree(value: Column) -> Column:
    """A nested value as indented text."""
    return F.to_json(value, {"pretty": "true"})


def size_info(sizes: Column, pixel_bytes: Column, dtype: Column, channels: Column, largest: str = "TB") -> Column:
    """A line on an image's levels (arrays x, y, z, c, t): sizes, type, bytes in all (in units up to the largest), channels."""
    each = F.array_join(F.transform(sizes, lambda s: F.concat(F.lit(" "), F.array_join(F.transform(s, lambda n: n.cast("string")), " "))), ",")
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, s: acc + F.aggregate(s, F.lit(1).cast("long"), lambda a, n: a * n)) * pixel_bytes
    names = F.when(sizes[0][3] == 3, F.lit("rgb")).otherwise(F.array_join(channels, ","))
    text = F.concat(F.lit("XYZCT:"), each, F.lit(" Pixel type: "), dtype, F.lit(" Uncompressed: "), human_bytes(total, largest))
    return F.when(names != "", F.concat(text, F.lit(" Channels: "), names)).otherwise(text)


def most_downsamples(height: Column, width: Column, wanted: int, factor: int) -> Column:
    """How many times an image can be made smaller, up to a wanted number, before a side is less than one pixel."""
    sides = [F.floor(F.least(height, width) / float(factor**i)) for i in range(1, wanted + 1)]
    return sum(((s >= 1).cast("int") for s in sides), F.lit(0))
