"""Date structures behind many frequent structures that are no date are found."""

from datelode.operators.mine import mined_patterns


def test_no_cap_before_dates(spark):
    seps = [a + b for a in "_-. :" for b in "_-. :"]
    names = [f"7654{s[0]}1{s[1]}{'9' * k}{t}" for s in seps for k in (3, 4, 6, 8) for t in ("", "x1", "x22") for _ in range(6)]
    names += [f"A{2001 + k}x{k + 1:02d}x{k + 10}" for k in range(5)]
    rows = [(str(k), n, f"{n}.jpg") for k, n in enumerate(names)]
    got = mined_patterns(spark.createDataFrame(rows, "item_id string, stem string, path string"))
    assert "MINED_4_2_2_day" in [p.name for p in got]
