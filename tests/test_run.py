"""A run from a folder of files to an export folder and back."""

import numpy as np
import pytest

from datelode import run
from datelode.options import Options
from test_media import jpeg, picture, png, tiff


@pytest.fixture
def album(tmp_path):
    files = {
        "trip/a.jpg": jpeg(tiff()),  # dated by its metadata, 2024-01-02
        "trip/b copy.jpg": jpeg(tiff()),  # the same content
        "trip/IMG_20240102_050607.jpg": jpeg() + b"1",
        "trip/IMG_7.jpg": jpeg() + b"2",  # between its neighbours
        "trip/IMG_20240102_090807.jpg": jpeg() + b"3",
        "shots/2024-03-04 x.png": png(np.zeros((4, 6, 3))),
        "shots/wrong.jpg": png(np.clip(picture(1), 0, 255).astype(np.uint8)[:, :, None], 0),
        "shots/smaller.png": png(np.clip(picture(1), 0, 255).astype(np.uint8)[::2, ::2, None].copy(), 0),
        "o'clock/notes.txt": b"no picture",
        ".hidden/x.jpg": jpeg(),
        "shots/y.tmp": b"skipped",
    }
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path, files


def test_run_to_an_export_folder(spark, album):
    tmp, files = album
    options = Options(input_dir=str(tmp / "in"), export_dir=str(tmp / "out"), dedup="phash", hamming=10, skip=frozenset({"tmp"}))
    got = run.run(spark, options)
    plan = {r.source_relpath: r for r in got.plan.collect()}
    assert set(plan) == {f for f in files if not f.startswith(".") and not f.endswith(".tmp")}
    assert plan["o'clock/notes.txt"].bucket == "unsupported" and plan["trip/IMG_20240102_050607.jpg"].bucket == "confident"
    assert plan["trip/a.jpg"].reason == "time conflict detected" and str(plan["trip/a.jpg"].final_datetime) == "2024-01-02 03:04:05"
    same = [plan["trip/a.jpg"], plan["trip/b copy.jpg"]]
    assert {r.duplicate_rank for r in same} == {0, 1} and len({r.duplicate_group_id for r in same}) == 1 and {r.duplicate_kind for r in same} == {"sha1"}
    near = [plan["shots/wrong.jpg"], plan["shots/smaller.png"]]
    assert {r.duplicate_rank for r in near} == {0, 1} and {r.duplicate_kind for r in near} == {"phash"}
    times = {r.item_id: r for r in got.resolved.collect()}
    between = times[plan["trip/IMG_7.jpg"].item_id]
    assert between.primary_source in ("timeline", "filesystem") and "timeline" in between.source_summary
    status = {r.item_id: r.status for r in got.status.collect()}
    out = tmp / "out"
    for r in plan.values():
        target = out / r.bucket / r.dest_relpath
        if r.action == "convert":
            assert status[r.item_id] == "failed" and not target.exists()
        else:
            assert status[r.item_id] == "done" and target.read_bytes() == (tmp / "in" / r.source_relpath).read_bytes()
            assert (target.parent / f"{target.name}.{r.bucket}.txt").exists() == (r.bucket in ("review", "duplicate"))
    assert "trip/a.jpg" in got.page or "trip/b copy.jpg" in got.page
    failed = sum(s == "failed" for s in status.values())
    assert run.retry(spark, options).count() == failed  # only what failed is tried again
    again = run.run(spark, options)
    assert {r.status for r in again.status.collect()} <= {"skipped", "failed"}


def test_dry_runs_write_nothing(spark, album):
    tmp, _ = album
    got = run.run(spark, Options(input_dir=str(tmp / "in"), dedup="no", mine=False), dry=True)
    assert got.status is None and got.patterns == [] and got.plan.where("duplicate_group_id <> ''").count() == 0 and not (tmp / "out").exists()
    with pytest.raises(ValueError):
        run.run(spark, Options(input_dir=str(tmp / "in"), export_dir=str(tmp / "in/out")))
    with pytest.raises(ValueError):
        run.run(spark, Options(input_dir=str(tmp / "in"), dedup="clip"), dry=True)
