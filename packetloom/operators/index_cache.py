"""An index of many sources that is built once: a refresh computes what is new or has changed, and nothing else.

A source is known by the MD5 digest of its name and is valid as long as its version is the same (a time of change, a size, a digest: any columns). A refresh joins the sources with
the table of those known, hands the rest to `build`, writes the index rows of these as a new part, and at last a new manifest. The manifest is one file that Spark's
writer puts in its place, so a refresh counts as a whole or not at all; readers see the one before it until then, and one that reads an old part goes on reading it. Sources that are gone, and old versions,
drop out of the table; their rows stay in their parts until parts are merged, which a refresh does once there are more than `max_parts`."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "gen long, id string, sources string, parts array<string>"
KEY, VERSION, PART = "__key", "__version", "__part"


class IndexCache:
    """An index in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, version: Sequence[str], source: str = "source", max_parts: int = 16):
        self.spark, self.folder, self.version, self.source, self.max_parts = spark, folder.rstrip("/"), list(version), source, max_parts

    def _manifest(self):
        try:
            found = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException:  # nothing has been refreshed yet
            return None
        return found.orderBy(F.desc("gen"), "id").first()

    def _rows(self, known: DataFrame, parts: Sequence[str]) -> DataFrame:
        """Index rows of the known versions. A part is read with what its rows are of; which of them count, the table of sources says."""
        read = self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts])
        return read.join(known.select(KEY, PART), [KEY, PART], "left_semi")

    def index(self) -> DataFrame:
        """The index as of the last refresh."""
        now = self._manifest()
        if now is None:
            raise ValueError(f"{self.folder}: no refresh has ended yet")
        return self._rows(self.spark.read.parquet(f"{self.folder}/{now.sources}"), now.parts).drop(KEY, VERSION, PART)

    def refresh(self, sources: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The index of `sources`, a row a source with its version columns; NULL is a version like any other. `build` gets the rows of sources that are new or changed, with all
        their columns, and returns index rows with the source's name in the same column; it may return any number of rows of a source, none too."""
        now, run = self._manifest(), uuid.uuid4().hex
        keyed = sources.withColumns({KEY: F.md5(F.col(self.source).cast("string").cast("binary")), VERSION: F.struct(*self.version)})
        if now is None:
            known, changed = None, keyed
        else:
            before = self.spark.read.parquet(f"{self.folder}/{now.sources}")
            old = before.select(F.col(KEY).alias("__k"), F.col(VERSION).alias("__v"))
            same = (F.col(KEY) == F.col("__k")) & F.col(VERSION).eqNullSafe(F.col("__v"))
            changed = keyed.join(old, same, "left_anti")
            here = keyed.select(F.col(KEY).alias("__k"), F.col(VERSION).alias("__v"))
            known = before.join(here, same, "left_semi")
        part = f"parts/{run}"
        new = build(changed.drop(KEY, VERSION))
        new.withColumns({KEY: F.md5(F.col(self.source).cast("string").cast("binary")), PART: F.lit(part)}).write.parquet(f"{self.folder}/{part}")
        listed = changed.select(KEY, VERSION, F.lit(part).alias(PART))
        parts = [*(now.parts if now else []), part]
        if len(parts) > self.max_parts:
            merged = f"parts/{run}-all"
            every = known.unionByName(listed)
            self._rows(every, parts).withColumn(PART, F.lit(merged)).write.parquet(f"{self.folder}/{merged}")
            table, parts = every.withColumn(PART, F.lit(merged)), [merged]
        else:
            table = listed if known is None else known.unionByName(listed)
        table.write.parquet(f"{self.folder}/sources/{run}")
        row = (now.gen + 1 if now else 0, run, f"sources/{run}", parts)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return self.index()
