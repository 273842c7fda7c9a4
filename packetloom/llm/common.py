"""What the corpus operators share: tables, lineage cuts, clash-free names, skew-safe look-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the characters that separate words, and of those that make one.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that hold at least 1/HOT of the rows are looked up by broadcast. As the weights sum to the rows, at most HOT keys can.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where that is unset
    (tests on one machine), a folder in the warehouse takes its place."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return context.getCheckpointDir()


#: Files of a written table, at most, for each core of the cluster.
FILES_A_CORE = 8


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: what follows neither recomputes it nor depends on an executor.
    Many small partitions are written by fewer tasks, still several a core, so no folder fills with small files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def body(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def lookup_join(rows: DataFrame, keyed: DataFrame, on: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once, and how many rows a key has in `weight`.

    Rows of hot keys don't shuffle: their keys, at most HOT, are broadcast. No other key has more than
    1/HOT of the rows, so the shuffled rest is even. Both inputs are read twice and should be cheap to read."""
    floor = max(2, total // HOT)
    hot = keyed.filter(F.col(weight) >= floor)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keyed.filter(F.col(weight) < floor), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


#: Parts of a group's range of hashes.
RANGES = 256


def few_of_each(rows: DataFrame, key: str, group: str, each: int, max_groups: int = 1000) -> DataFrame:
    """Distinct rows: of every group about `each`, not more, those with the least hashes of the key. Of large groups only a thin range of
    hashes, some three times as many rows as needed, is looked at; it is cut where a histogram of RANGES parts a group reaches
    `each`, so no task ranks a group. More than max_groups groups are refused."""
    spark = rows.sparkSession
    sizes = rows.groupBy(group).count().limit(max_groups + 1).collect()
    if len(sizes) > max_groups:
        raise ValueError(f"more than {max_groups} groups in {group}")
    kind = rows.schema[group].dataType.simpleString()
    h, part, at, last = fresh(rows, "h", "part", "at", "last")
    share = [(r[0], 1.0 if r["count"] <= 4 * each else (3 * each + 100) / r["count"]) for r in sizes]
    thin = rows.join(F.broadcast(spark.createDataFrame(share, f"{group} {kind}, {part} double")), group)  # max_groups rows
    thin = thin.withColumn(h, F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)).filter(F.col(h) < F.col(part))
    thin = thin.withColumn(at, F.floor(F.col(h) / F.col(part) * RANGES).cast("int")).drop(h, part).distinct()
    counts: dict = {}
    for r in thin.groupBy(group, at).count().collect():
        counts.setdefault(r[0], {})[r[1]] = r["count"]
    cuts = []
    for g, own in counts.items():
        n, upto = 0, -1
        for k in sorted(own):
            n += own[k]
            if n > each:
                break
            upto = k
        cuts.append((g, upto))
    chosen = thin.join(F.broadcast(spark.createDataFrame(cuts, f"{group} {kind}, {last} int")), group)
    return chosen.filter(F.col(at) <= F.col(last)).select(*rows.columns)
