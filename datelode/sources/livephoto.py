"""Photos inside zip archives: the one to keep is chosen by its type and read out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of photos, the best first.
TYPES = ["heic", "heif", "jpg", "jpeg", "png"]
#: Larger archives than this are reported and not read.
MAX_BYTES = 256 << 20


def choose(names: list[str]) -> str | None:
    """The photo of an archive: the best type, then the first by name; entries under __ are none."""
    ranked = [(TYPES.index(ext), n) for n in names if not n.startswith("__") and (ext := n.rsplit(".", 1)[-1].lower()) in TYPES]
    return min(ranked)[1] if ranked else None


def unpack(spark: SparkSession, root: str, pattern: str = "*.livp") -> DataFrame:
    """path, name, content, error of each archive below root: its photo's name and bytes, or why there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", "length", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = content = error = None
                raw = batch.column("content")[k].as_py()
                try:
                    if raw is None:
                        raise ValueError(f"more than {MAX_BYTES} bytes")
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        if (name := choose(z.namelist())) is None:
                            raise ValueError("no photo inside")
                        content = z.read(name)
                except Exception as e:  # noqa: BLE001  one broken archive is its row's error
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(k, 1), pa.array([name], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "name", "content", "error"])

    return rows.mapInArrow(run, "path string, name string, content binary, error string")
