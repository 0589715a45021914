"""Carrying out an export plan: files are copied by tasks, again and again with the same outcome."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.operators.components import saved

CHUNK = 1 << 20


def check_target(export_dir: str, input_dir: str) -> None:
    """Refuses an export folder that is the input folder or lies in it."""
    out, source = (posixpath.normpath(p) + "/" for p in (export_dir, input_dir))
    if input_dir and out.startswith(source):
        raise ValueError(f"the export folder {export_dir} must not be inside the input folder {input_dir}")


def _digest(fs, path: str) -> str:
    with fs.open_input_stream(path) as f:
        h = hashlib.sha1()
        while part := f.read(CHUNK):
            h.update(part)
    return h.hexdigest()


def _put(fs, source: str, target: str, attempt: int = 0) -> None:
    """Copies to a name of this attempt's own, then renames: a lost task leaves no half file, two at once do not meet in one."""
    fs.create_dir(posixpath.dirname(target), recursive=True)
    part = f"{target}.{attempt}.{hashlib.sha1(source.encode()).hexdigest()[:8]}.part"
    with fs.open_input_stream(source) as a, fs.open_output_stream(part) as b:
        while chunk := a.read(CHUNK):
            b.write(chunk)
    fs.move(part, target)


def execute(plan: DataFrame, input_dir: str, export_dir: str, notes: DataFrame | None = None, filesystem=None) -> DataFrame:
    """item_id, status (done, skipped, failed), error for each row of plan; append it to the status log.

    Files go to export_dir/bucket/dest_relpath. One that stands there with the same content is left alone; a
    conversion needs an image library that is not here, so its row fails and says so. notes(item_id, note) are
    written beside files of the buckets review and duplicate. filesystem: any of Arrow's (object stores
    too); without one, the file system that all executors mount. The plan is written before it is carried out, and
    so is the outcome: files are copied once, however often the returned rows are read.
    """
    check_target(export_dir, input_dir)
    plan = saved(plan)
    rows = plan.select("item_id", "action", "bucket", "source_relpath", "dest_relpath")
    rows = rows.join(notes.select("item_id", "note"), "item_id", "left") if notes is not None else rows.withColumn("note", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        fs = filesystem or arrow_fs.LocalFileSystem()
        for batch in batches:
            ids, status, errors = [], [], []
            for r in batch.to_pylist():
                source, target = f"{input_dir}/{r['source_relpath']}", f"{export_dir}/{r['bucket']}/{r['dest_relpath']}"
                try:
                    if r["action"] == "convert":
                        raise NotImplementedError("no image library for a conversion")
                    there = fs.get_file_info(target).type != arrow_fs.FileType.NotFound and _digest(fs, target) == _digest(fs, source)
                    if not there:
                        _put(fs, source, target, TaskContext.get().taskAttemptId())
                    if r["note"] and r["bucket"] in ("review", "duplicate"):
                        with fs.open_output_stream(f"{target}.{r['bucket']}.txt") as f:
                            f.write(r["note"].encode())
                    outcome = ("skipped", "already there with the same content") if there else ("done", "")
                except Exception as e:  # noqa: BLE001  one file's failure is its row's status
                    outcome = ("failed", f"{type(e).__name__}: {e}")
                ids.append(r["item_id"])
                status.append(outcome[0])
                errors.append(outcome[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(status, pa.string()), pa.array(errors, pa.string())], names=["item_id", "status", "error"])

    return saved(rows.mapInArrow(run, "item_id string, status string, error string"))
