"""Tiles that arrive over time: each micro-batch is paired with itself and with the tiles known before that are near it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators import tiles


def pair_arrivals(spark: SparkSession, arriving: DataFrame, known: str, edges: str, checkpoint: str):
    """Starts a query over all tiles there are (``availableNow``) that writes new pairs to ``edges``.

    Batches are written to folders of their own number, so a batch that is run again replaces itself.
    """
    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(["tile_id"]).cache()
        path = spark._jvm.org.apache.hadoop.fs.Path(known)
        before = [p for p in (path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{known}/batch=*")) or ()) if int(p.getPath().getName().split("=")[1]) < number]
        found = tiles.pairs(rows)
        if before:
            known_rows = spark.read.parquet(*(p.getPath().toString() for p in before)).select(*rows.columns).join(rows.select("tile_id"), "tile_id", "left_anti")
            found = found.unionByName(tiles.pairs_between(rows, known_rows))
        found.write.mode("overwrite").parquet(f"{edges}/batch={number}")
        rows.write.mode("overwrite").parquet(f"{known}/batch={number}")
        rows.unpersist()

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type and tumbling window, with late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
