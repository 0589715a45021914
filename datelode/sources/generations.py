"""An append-only log by generations: keyed rows that are looked up, read first or last, and merged a few at a time.

An append writes one generation: its rows, sorted by ranges of the key, as Parquet in a folder of its own, then
one manifest row a file (key range, rows). The manifest's append is the commit; what a lost run has
written without it is never read. A row keeps its place (generation, line) for good, so the first and the last row of
a key are exact whatever is merged since. A lookup reads only files whose key range holds one of its keys, and
Parquet's own statistics skip the rest inside them. merge() puts FANOUT generations of one level into one of
the next and keeps the first and the last row of each key; larger generations are left alone, so a row is
rewritten once a level, not once a merge. The folders of merged generations stay until they are removed.

One writer at a time. Keys are texts; rows with a null key are not kept. Repeated rows keep their order only within
a partition of what is appended; a null in other columns is a value like any other. An empty append changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
PLACE = ["__gen", "__line"]
_MANIFEST = "gen long, level int, file string, low string, high string, rows long, replaced array<long>"


class Generations:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", files: int | None = None) -> None:
        self.spark, self.path, self.key, self.files = spark, path.rstrip("/"), key, files
        self.schema = spark.createDataFrame([], f"{schema}, __gen long, __line long").schema

    def manifest(self) -> DataFrame:
        """One row a live file."""
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)
        gone = rows.select(F.explode("replaced").alias("gen")).distinct()
        return rows.join(F.broadcast(gone), "gen", "left_anti").where("file IS NOT NULL")

    def _next(self) -> int:
        try:
            return (self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").agg(F.max("gen")).first()[0] or 0) + 1
        except AnalysisException:
            return 1

    def _write(self, rows: DataFrame, gen: int, level: int, replaced: list[int]) -> None:
        folder = f"{self.path}/data/{gen}-{uuid.uuid4().hex}"
        n = self.files or max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.repartitionByRange(n, self.key, *PLACE).sortWithinPartitions(self.key, *PLACE).write.parquet(folder)
        written = self.spark.read.schema(self.schema).parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))
        old = F.array(*map(F.lit, replaced)).cast("array<long>")
        entries = written.select(F.lit(gen).alias("gen"), F.lit(level).alias("level"), "file", "low", "high", "rows", old.alias("replaced"))
        if replaced:  # what it replaces goes even where nothing is left
            entries = entries.unionByName(self.spark.range(1).select(F.lit(gen).alias("gen"), F.lit(level).alias("level"), old.alias("replaced")), allowMissingColumns=True)
        entries.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def append(self, rows: DataFrame) -> None:
        rows = rows.where(F.col(self.key).isNotNull())
        if rows.isEmpty():
            return
        gen = self._next()
        self._write(rows.withColumns({"__gen": F.lit(gen).cast("long"), "__line": F.monotonically_increasing_id()}), gen, 0, [])

    def rows(self, keys: list[str] | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
        """All rows, or those of some keys, or of a range of keys, with their places."""
        files, here = self.manifest(), F.lit(True)
        if keys is not None:
            listed = F.array(*map(F.lit, keys)).cast("array<string>")
            files, here = files.where(F.exists(listed, lambda k: (k >= F.col("low")) & (k <= F.col("high")))), F.col(self.key).isin(keys)
        if low is not None:
            files, here = files.where(F.col("high") >= low), here & (F.col(self.key) >= low)
        if high is not None:
            files, here = files.where(F.col("low") <= high), here & (F.col(self.key) <= high)
        paths = [r.file for r in files.select("file").collect()]
        return self.spark.read.schema(self.schema).parquet(*paths).where(here) if paths else self.spark.createDataFrame([], self.schema)

    def _pick(self, rows: DataFrame, how) -> DataFrame:
        rest = [c for c in self.schema.names if c not in (self.key, *PLACE)]
        return rows.groupBy(self.key).agg(how(F.struct(*rest), F.struct(*PLACE)).alias("r")).select(self.key, *[F.col(f"r.{c}").alias(c) for c in rest])

    def last(self, **which) -> DataFrame:
        """The last row of each key."""
        return self._pick(self.rows(**which), F.max_by)

    def first(self, **which) -> DataFrame:
        return self._pick(self.rows(**which), F.min_by)

    def split_known(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of files whose key the log has, and the others; only files of the range that these keys span are read."""
        ends = files.agg(F.min(self.key), F.max(self.key)).first()
        known = self.rows(low=ends[0], high=ends[1]).select(self.key).distinct()
        return files.join(known, self.key, "left_semi"), files.join(known, self.key, "left_anti")

    def merge(self, fanout: int = FANOUT) -> int:
        """Merges generations level by level while one has fanout of them; returns how many merges were made."""
        done = 0
        while True:
            gens = self.manifest().groupBy("level").agg(F.array_sort(F.collect_set("gen")).alias("gens")).where(F.size("gens") >= fanout).orderBy("level").first()
            if gens is None:
                return done
            some = gens.gens[:fanout]
            paths = [r.file for r in self.manifest().where(F.col("gen").isin(some)).select("file").collect()]
            whole, place = F.struct(*self.schema.names), F.struct(*PLACE)
            ends = self.spark.read.schema(self.schema).parquet(*paths).groupBy(self.key).agg(F.array_distinct(F.array(F.min_by(whole, place), F.max_by(whole, place))).alias("ends"))
            self._write(ends.select(F.explode("ends").alias("r")).select("r.*"), self._next(), gens.level + 1, some)
            done += 1
