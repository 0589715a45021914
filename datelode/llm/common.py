"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python task, in bytes.
SLICE_BYTES = 2_000_000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop) is a local folder made and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark, "_datelode_scratch", None) or tempfile.mkdtemp(prefix="datelode-")
        spark._datelode_scratch = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path, schema = df.sparkSession, scratch_dir(df.sparkSession), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def beside(docs: DataFrame, names: list[str], run, ddl: str) -> DataFrame:
    """mapInArrow over the UTF-8 text of docs that leaves the columns of names as they are.

    run(bodies) gives the Arrow columns of ddl for a list of texts; in tasks the other columns go by number,
    so any name will do.
    """
    rows = docs.select(*[column(c).alias(f"c{k}") for k, c in enumerate(names)], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    made = [x.split()[0] for x in ddl.split(", ")]
    kinds = [f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "body", 4_000_000):
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], *run(piece.column("body").to_pylist())], names=[*(f"c{k}" for k in range(len(names))), *made])

    out = rows.mapInArrow(work, ", ".join([*kinds, ddl]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *made)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, and that column's name.

    The number is doc_id where ids are whole numbers and all different; else (null, repeated or textual
    ids) rows are numbered and written once, so that each later use sees the same numbers.
    """
    name = fresh(docs, "row")
    if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        n, ids = docs.select(F.count("*"), F.countDistinct("doc_id")).first()
        if n == ids:
            return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id())), name


def doc_bytes(df: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text (null: empty)."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about limit bytes of column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    yield batch.slice(start)
