"""What stands at the end of a table, without reading all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def last_values(table: DataFrame, streams: DataFrame, key: str, order: str, value: Column, first: int = 1) -> tuple[DataFrame, int]:
    """(key, value of the stream's last row in `order`) for each of `streams`, NULL where it has none; and how many files were read.

    table is read from files whose names follow `order`, as a sort over the whole table writes them. The last `first` files are read, then as many again, twice as many, and so on until
    every stream has been met, or nothing is left; no file is read twice. What is found is a row a stream and round."""
    files = sorted(table.inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])
    spark, found, behind, take = table.sparkSession, [], len(files), first
    wanted = streams.select(key).distinct()
    while behind > 0:
        part = spark.read.schema(table.schema).parquet(*files[max(0, behind - take) : behind])
        row = part.filter(F.col(order).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias("value"), F.max(order).alias("__at"))
        found.append(scan.settle(row.join(wanted, key, "left_semi")))
        behind = max(0, behind - take)
        take = len(files) - behind
        known = reduce(DataFrame.unionByName, found)
        if not wanted.join(known, key, "left_anti").head(1):
            break
    if not found:
        return streams.select(key, F.lit(None).cast("long").alias("value")), 0
    best = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.max_by("value", "__at").alias("value"))
    return streams.join(best, key, "left").select(key, "value"), len(files) - behind
