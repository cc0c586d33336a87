"""Labels that tell the files of a fileset apart, from the numbers in their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import text


def changing(files: DataFrame) -> DataFrame:
    """(fileset, file, key, value, label, place) of the entries whose key has several values in a fileset.

    ``files`` has fileset, file (its order) and entries, as of :func:`text.labelled_entries`. A file without a key
    is a value of its own. ``place`` orders keys by where they come first.
    """
    rows = files.select("fileset", "file", F.posexplode("entries").alias("i", "e")).select("fileset", "file", "i", "e.key", "e.value", "e.label")
    sizes = files.groupBy("fileset").agg(F.count("*").alias("files"))
    keys = rows.groupBy("fileset", "key").agg(F.count_distinct("value").alias("values"), F.count("*").alias("held"), F.min(F.struct("file", "i")).alias("place"))
    keys = keys.join(sizes, "fileset").where("values > 1 OR held < files").select("fileset", "key", "place")
    return rows.join(keys, ["fileset", "key"]).select("fileset", "file", "key", "value", "label", "place")


def candidate(files: DataFrame) -> DataFrame:
    """(fileset, file, label, unique): changing entries put together, and whether they tell all files of the fileset apart."""
    parts = changing(files).groupBy("fileset", "file").agg(F.array_sort(F.collect_list(F.struct("place", "label", "value"))).alias("parts"))
    joined = files.select("fileset", "file").join(parts, ["fileset", "file"], "left").select(
        "fileset", "file", F.coalesce(F.array_join(F.transform("parts", lambda p: F.concat(p["label"], p["value"])), "_"), F.lit("")).alias("label"),
        F.coalesce(F.array_join(F.transform("parts", lambda p: p["value"]), "_"), F.lit("")).alias("plain"),
    )
    unique = joined.groupBy("fileset").agg(((F.count_distinct("plain") == F.count("*")) & (F.count_distinct("label") == F.count("*"))).alias("unique"))
    return joined.join(unique, "fileset").select("fileset", "file", "label", "unique")


def file_labels(files: DataFrame) -> DataFrame:
    """(fileset, file, label) of ``files`` (fileset, file, path): the shortest rule that tells all of a fileset's files apart.

    Numbers of the title, then of the whole path, then its numbers by place; else the title. The only file of a fileset has an empty label.
    """
    path = F.col("path")
    title, by_place = text.labelled_entries(text.file_title(path)), F.transform(text.numeric_parts(path), lambda p, i: F.struct(i.cast("string").alias("key"), p.alias("value"), F.lit("").alias("label")))
    out = files.select("fileset", "file", text.file_title(path).alias("title"))
    for n, entries in enumerate((title, text.labelled_entries(path), by_place)):
        found = candidate(files.select("fileset", "file", entries.alias("entries")))
        out = out.join(found.select("fileset", "file", F.when(F.col("unique"), F.col("label")).alias(f"label{n}")), ["fileset", "file"])
    return out.select("fileset", "file", F.coalesce("label0", "label1", "label2", "title").alias("label"))
