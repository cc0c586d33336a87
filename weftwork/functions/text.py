"""Column builders for file names, labels and numbers in text; all run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times and computes it once."""
    return F.transform(F.array(value), use)[0]


def path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\\", "/"), "/")


def file_title(path: Column) -> Column:
    """Name without folder, extension and a trailing ``.ome``."""
    name = F.element_at(path_parts(path), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"\.ome$", "")


def numbers(text: Column) -> Column:
    """All runs of digits as integers; arrays order as lists of integers do, so this is also the sort key of files."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def name_parts(text: Column) -> Column:
    return F.filter(F.split(text, r"[/\\._-]"), lambda x: x != "")


def numeric_parts(text: Column) -> Column:
    return F.filter(name_parts(text), lambda x: x.rlike(r"\d"))


def target_number(text: Column, target: str | None) -> Column:
    """The number after a label in any part of a name; without a label the first number."""
    pattern = r"(\d+)" if not target else rf"(?:^|[/\\._-]){re.escape(target)}(\d+)(?:$|[/\\._-])"
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.cast("long"))


def labelled_numbers(text: Column) -> Column:
    """Sorted "label=digits" entries of the parts with digits; a part without a label is named by its place."""
    named = F.transform(numeric_parts(text), lambda p, i: F.concat(F.when(p.rlike(r"^\d"), i.cast("string")).otherwise(F.regexp_extract(p, r"^(\D*)", 1)), F.lit("="), F.regexp_extract(p, r"(\d+)", 1)))
    return F.array_sort(F.array_distinct(named))


def number_or_text(text: Column) -> Column:
    """Tokens of a text: numbers and what stands between them."""
    return F.regexp_extract_all(text, F.lit(r"([0-9.]+|[^0-9.]+)"), 1)


def fixed(x: Column, decimals: int) -> Column:
    """A double with some decimals as C and Python print it: its exact value rounded, ties to an even digit.

    Java's formats round the shortest digits that stand for a double, and halves up. From 2^63 on the digits are Java's.
    """
    scale = 10.0**decimals
    split = lambda v: v * 134217729.0 - (v * 134217729.0 - v)  # noqa: E731  a double's upper half; what is left has the lower
    high = float(scale * 134217729.0 - (scale * 134217729.0 - scale))

    def digits(a: Column) -> Column:
        part = F.struct((a - F.floor(a)).alias("f"), (F.rint(a) if decimals == 0 else F.floor(a)).cast("long").alias("whole"))
        halves = let(part, lambda p: F.struct(p["whole"].alias("whole"), p["f"].alias("f"), (p["f"] * scale).alias("p"), split(p["f"]).alias("h")))

        def rounded(p: Column) -> Column:
            low = p["f"] - p["h"]
            error = p["h"] * high - p["p"] + p["h"] * (scale - high) + low * high + low * (scale - high)  # of the product, exact
            tie = p["p"] - F.floor(p["p"]) == 0.5
            return F.struct(p["whole"].alias("whole"), F.when(tie & (error > 0), F.ceil(p["p"])).when(tie & (error < 0), F.floor(p["p"])).otherwise(F.rint(p["p"])).cast("long").alias("r"))

        def shown(p: Column) -> Column:
            full = (p["r"] >= int(scale)).cast("long")
            return F.concat((p["whole"] + full).cast("string"), F.lit("."), F.lpad((p["r"] - full * int(scale)).cast("string"), decimals, "0"))

        return let(part, lambda p: p["whole"].cast("string")) if decimals == 0 else let(let(halves, rounded), shown)

    x = x.cast("double")
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    infinite = F.abs(x) == float("inf")
    body = F.when(infinite, "inf").when(F.abs(x) < 2.0**63, let(F.abs(x), digits)).otherwise(F.format_string(f"%.{decimals}f", F.abs(x)))
    return F.when(F.isnan(x), "nan").when(x.isNotNull(), F.concat(sign, body))


def human_bytes(n: Column, largest: str = "TB") -> Column:
    """1024-based size with one decimal; a unit up to the largest is used above, not at, its size."""
    size, unit, names = n.cast("double"), F.lit("B"), ("KB", "MB", "GB", "TB")
    for power, name in enumerate(names[: names.index(largest) + 1], 1):
        size, unit = F.when(n > 1024**power, n / float(1024**power)).otherwise(size), F.when(n > 1024**power, F.lit(name)).otherwise(unit)
    return F.concat(fixed(size, 1), unit)


def significant(x: Column, digits: int) -> Column:
    factor = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * factor) / factor)


def arithmetic(expression: str, names: set[str]) -> Column:
    """A metadata expression over known names: numbers, ``+ - * / ( )`` and ``fn[i]`` (i-th number of the file name)."""
    tokens = re.findall(r"\s*(fn\[-?\d+\]|[A-Za-z_]\w*|\d+\.?\d*|[-+*/()])", expression)
    if "".join(tokens) != re.sub(r"\s+", "", expression) or any(re.match(r"[A-Za-z_]", t) and not t.startswith("fn[") and t not in names for t in tokens):
        raise ValueError(f"not an arithmetic expression over {sorted(names)}: {expression}")

    def place(token: str) -> str:
        m = re.fullmatch(r"fn\[(-?\d+)\]", token)
        return f"try_element_at(fn, {int(m[1]) + (int(m[1]) >= 0)})" if m else f"CAST({token} AS DOUBLE)" if token[0].isdigit() else token

    return F.expr(" ".join(map(place, tokens))).cast("double")


def numbers_and_text(text: Column) -> Column:
    """Tokens as (number, text), trimmed; separators alone are left out."""
    parts = F.filter(F.transform(number_or_text(text), lambda t: F.trim(t)), lambda t: ~t.isin("", ",", "|"))
    return F.transform(parts, lambda t: F.struct(t.try_cast("double").alias("number"), F.when(t.try_cast("double").isNull(), t).alias("text")))


def values_with_units(text: Column) -> Column:
    """(value, unit) of a text such as "1 mm, 2 µm"; a number before a number has the unit that ends the text."""

    def paired(parts: Column) -> Column:
        last = F.coalesce(F.get(parts, F.size(parts) - 1)["text"], F.lit(""))
        unit = lambda i: F.when(i + 1 >= F.size(parts), F.lit("")).otherwise(F.coalesce(F.get(parts, i + 1)["text"], last))
        return F.filter(F.transform(parts, lambda p, i: F.struct(p["number"].alias("value"), unit(i).alias("unit"))), lambda p: p["value"].isNotNull())

    return let(numbers_and_text(text), paired)


def described(text: Column) -> Column:
    """A map of a description: of "k=v" or "k:v" items between line ends, tabs or bars, or of a JSON object; values as text."""
    items = F.filter(F.split(text, r"[\r\n\t|]"), lambda x: x.rlike("[=:]"))
    halves = F.transform(items, lambda x: F.when(F.contains(x, F.lit(":")), F.split(x, ":")).otherwise(F.split(x, "=")))
    entries = F.transform(halves, lambda h: F.struct(F.trim(h[0]).alias("key"), F.trim(h[1]).alias("value")))
    last = let(entries, lambda es: F.map_from_entries(F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda o: o["key"] == e["key"]))))
    return F.when(F.startswith(F.trim(text), F.lit("{")), F.from_json(text, "map<string, string>")).otherwise(last)


def typed(value: Column) -> Column:
    """A description's value as (integer, number, flag, text): the first that it reads as is set."""
    integer, number, flag = value.try_cast("long"), value.try_cast("double"), F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true")
    whole = F.when(value.rlike(r"^[+-]?\d+$"), integer)
    return F.struct(whole.alias("integer"), F.when(whole.isNull(), number).alias("number"), flag.alias("flag"), F.when(number.isNull() & flag.isNull(), value).alias("text"))


def rounded_if_near(x: Column, digits: int) -> Column:
    """The number to some significant digits where that changes it by less than its last digit's part, else the number."""
    near = significant(x, digits)
    change = F.when(x != 0, F.abs(1 - near / x)).otherwise(F.abs(near - x))
    return F.when(change < 10.0**-digits, near).otherwise(x)


def labelled_entries(text: Column) -> Column:
    """(key, value, label) of the parts with digits, in order: the label before the digits, or its place; the last of a key counts."""
    label = lambda p: F.regexp_extract(p, r"^(\D*)", 1)
    entries = F.transform(numeric_parts(text), lambda p, i: F.struct(F.when(label(p) == "", i.cast("string")).otherwise(label(p)).alias("key"), F.regexp_extract(p, r"(\d+)", 1).alias("value"), label(p).alias("label")))

    def last(es: Column) -> Column:
        first = F.filter(es, lambda e, i: ~F.exists(F.slice(es, 1, i), lambda o: o["key"] == e["key"]))
        return F.transform(first, lambda e: F.element_at(F.filter(es, lambda o: o["key"] == e["key"]), -1))

    return let(entries, last)


def slice_label(number: Column) -> Column:
    """The label of a slice by its number, as mappings are keyed."""
    return F.concat(F.lit("slice"), F.lpad(number.cast("string"), 5, "0"))
