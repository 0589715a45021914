"""Headers, metadata and picture hashes of files made here, whole and broken."""

import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelode.operators import dedup
from datelode.sources import media


def tiff(order="<", huge=False, size=None):
    """A directory with two names, pointers to one of times and one of a position."""
    tail, entries = bytearray(), {"top": [], "exif": [], "gps": []}
    n = {"top": 5 + (2 if size else 0) + huge, "exif": 2, "gps": 8}
    start = {"top": 8}
    start["exif"] = start["top"] + 2 + 12 * n["top"] + 4
    start["gps"] = start["exif"] + 2 + 12 * n["exif"] + 4
    end = start["gps"] + 2 + 12 * n["gps"] + 4

    def put(where, tag, kind, count, raw):
        if len(raw) > 4:
            at = end + len(tail)
            tail.extend(raw)
            raw = struct.pack(order + "I", at)
        entries[where].append(struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0"))

    text = lambda where, tag, s: put(where, tag, 2, len(s) + 1, s.encode() + b"\0")
    ratio = lambda where, tag, *x: put(where, tag, 5, len(x), b"".join(struct.pack(order + "II", a, b) for a, b in x))
    if size:
        put("top", 256, 4, 1, struct.pack(order + "I", size[0]))
        put("top", 257, 3, 1, struct.pack(order + "H", size[1]))
    text("top", 271, " Canon ")
    text("top", 272, "EOS")
    text("top", 306, "2024:05:06 07:08:09")
    if huge:
        put("top", 700, 7, 1_379_481_600, struct.pack(order + "I", 8))
    put("top", 34665, 4, 1, struct.pack(order + "I", start["exif"]))
    put("top", 34853, 4, 1, struct.pack(order + "I", start["gps"]))
    text("exif", 36867, "2024:01:02 03:04:05")
    text("exif", 36868, "0000:00:00 00:00:00")
    text("gps", 1, "S")
    ratio("gps", 2, (33, 1), (30, 1), (3600, 100))
    text("gps", 3, "E")
    ratio("gps", 4, (151, 1), (0, 1), (0, 0))
    put("gps", 5, 1, 1, b"\1")
    ratio("gps", 6, (125, 10))
    ratio("gps", 7, (1, 1), (2, 1), (359, 100))
    text("gps", 29, "2024:01:02")
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    for where in ("top", "exif", "gps"):
        assert len(entries[where]) == n[where]
        out += struct.pack(order + "H", n[where]) + b"".join(entries[where]) + b"\0" * 4
    return out + bytes(tail)


def jpeg(exif=b"", multi=False):
    part = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + (part(0xE1, b"Exif\0\0" + exif) if exif else b"") + (part(0xE2, b"MPF\0") if multi else b"") + part(0xC4, b"\0" * 30) + part(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\3") + part(0xDA, b"\0" * 4) + b"\1\2\3\xff\xd9"


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(pixels, colour=2, depth=8, filters=(0,), palette=b"", extra=b"", cut=None):
    """pixels: (height, width, lanes) bytes, or values below 2 ** depth; filters go round by line."""
    h, w = pixels.shape[:2]
    lines = pixels.reshape(h, -1).astype(np.uint8)
    if depth < 8:
        bits = np.unpackbits(lines[:, :, None], axis=2)[:, :, 8 - depth :].reshape(h, -1)
        lines = np.packbits(bits, axis=1)
    step = max(1, lines.shape[1] // w if depth >= 8 else 1)
    raw, above = bytearray(), [0] * lines.shape[1]
    for y, line in enumerate(lines.tolist()):
        kind = filters[y % len(filters)]
        raw.append(kind)
        for k, v in enumerate(line):
            left, top, corner = line[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            p = left + top - corner
            near = min((abs(p - left), 0, left), (abs(p - top), 1, top), (abs(p - corner), 2, corner))[2]
            raw.append((v - [0, left, top, (left + top) // 2, near][kind]) & 255)
        above = line
    packed = zlib.compress(bytes(raw))
    packed = packed[:cut] if cut else packed
    half = len(packed) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


def box(name, body):
    return struct.pack(">I", len(body) + 8) + name + body


def heif(exif):
    item = struct.pack(">I", 6) + b"Exif\0\0" + exif
    infe = box(b"infe", struct.pack(">B3xHH4s", 2, 7, 0, b"Exif") + b"\0")
    ispe = box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 64, 48)) + box(b"ispe", struct.pack(">III", 0, 4000, 3000))))
    head = box(b"ftyp", b"heic\0\0\0\0mif1heic")

    def meta(offset):
        iloc = box(b"iloc", struct.pack(">B3xBBHHHHII", 0, 0x44, 0, 1, 7, 0, 1, offset, len(item)))
        return box(b"meta", b"\0" * 4 + box(b"iinf", struct.pack(">IH", 0, 1) + infe) + ispe + iloc)

    return head + meta(len(head) + len(meta(0)) + 8) + box(b"mdat", item)


FACTS = (datetime(2024, 1, 2, 3, 4, 5), None, datetime(2024, 5, 6, 7, 8, 9), -33.51, 151.0, -12.5, datetime(2024, 1, 2, 1, 2, 3), "Canon", "EOS")


def read(spark, files):
    rows = media.read_media(spark.createDataFrame([(k, None if b is None else bytearray(b), "clash") for k, b in enumerate(files)], "id int, content binary, width string"))
    assert rows.columns[0] == "id" and rows.columns.count("width") == 1
    return [tuple(r[1:]) for r in rows.orderBy("id").collect()]


def test_formats_and_fields(spark):
    webp = lambda *c: b"RIFF\0\0\0\0WEBP" + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in c)
    files = [jpeg(tiff("<")), jpeg(tiff(">"), multi=True), png(np.zeros((3, 5, 3)), extra=chunk(b"eXIf", tiff())), heif(tiff(">")), webp((b"VP8X", b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), (b"EXIF", tiff())), tiff("<", size=(70, 60)), jpeg(tiff(huge=True))]
    sizes = [("JPEG", 40, 30), ("MPO", 40, 30), ("PNG", 5, 3), ("HEIF", 4000, 3000), ("WEBP", 100, 50), ("TIFF", 70, 60), ("JPEG", 40, 30)]
    got = read(spark, files)
    assert [g[:3] for g in got] == sizes
    assert all(g[3:] == FACTS for g in got), got
    plain = [b"GIF89a" + struct.pack("<HH", 7, 8), b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -11), webp((b"VP8L", b"\x2f" + struct.pack("<I", 12 | 13 << 14))), webp((b"VP8 ", b"\0" * 6 + struct.pack("<HH", 21, 22))), b"hello", b"", None, jpeg()]
    assert [g[:3] for g in read(spark, plain)] == [("GIF", 7, 8), ("BMP", 9, 11), ("WEBP", 13, 14), ("WEBP", 21, 22), ("", None, None), ("", None, None), ("", None, None), ("JPEG", 40, 30)]
    assert read(spark, []) == []


def test_broken_files_cost_nothing():
    import tracemalloc

    rng = random.Random(5)
    whole = [jpeg(tiff(huge=True)), heif(tiff()), png(np.zeros((3, 5, 3)), extra=chunk(b"eXIf", tiff())), tiff(">")]
    tracemalloc.start()
    for _ in range(3000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(0, 6)):
            data[rng.randrange(len(data))] = rng.choice([0, 255, rng.randrange(256)])
        data = bytes(data[: rng.randint(0, len(data))]) if rng.random() < 0.5 else bytes(data)
        try:
            media.media_facts(data)
        except (struct.error, IndexError):
            pass
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_lines_of_all_kinds():
    rng = np.random.default_rng(3)
    grey = lambda rgb: rgb @ np.array([0.299, 0.587, 0.114])
    lines = lambda data: np.array(list(media.png_lines(data)))
    for lanes, colour in ((1, 0), (3, 2), (2, 4), (4, 6)):
        p = rng.integers(0, 256, (11, 7, lanes))
        want = p[:, :, 0] if lanes < 3 else grey(p[:, :, :3])
        assert np.allclose(lines(png(p, colour, filters=(0, 1, 2, 3, 4))), want)
    deep = rng.integers(0, 256, (6, 5, 6))
    assert np.allclose(lines(png(deep, 2, 16, filters=(4, 3))), grey(deep[:, :, ::2]))
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    for depth in (1, 2, 4, 8):
        p = rng.integers(0, min(16, 1 << depth), (9, 13, 1))
        assert np.allclose(lines(png(p, 3, depth, filters=(1, 4), palette=palette.tobytes())), grey(palette[p[:, :, 0]]))
    few = rng.integers(0, 4, (5, 6, 1))
    assert np.allclose(lines(png(few, 0, 2)), few[:, :, 0] * 85)


def by_hand(pixels):
    """The hash over the whole picture at once, cosines summed one by one."""
    h, w = pixels.shape
    cells = np.array([[pixels[y * h // 32 : max((y + 1) * h // 32, y * h // 32 + 1), x * w // 32 : max((x + 1) * w // 32, x * w // 32 + 1)].mean() for x in range(32)] for y in range(32)])
    low = np.array([[sum(cells[y, x] * np.cos(np.pi * u * (y + 0.5) / 32) * np.cos(np.pi * v * (x + 0.5) / 32) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
    return "".join("1" if b else "0" for b in (low > np.median(low)).ravel())


def picture(seed, h=90, w=120):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return sum(rng.uniform(20, 60) * np.sin(rng.uniform(0.02, 0.12) * x + rng.uniform(0.02, 0.12) * y + rng.uniform(0, 6)) for _ in range(5)) / 3 + 128


def test_hashes(spark):
    files, bits = [], []
    for k, (h, w) in enumerate([(90, 120), (33, 70), (5, 9), (64, 64)]):
        p = np.clip(picture(k, h, w), 0, 255).astype(np.uint8)
        files.append(png(p[:, :, None], 0, filters=(1, 2)))
        bits.append(by_hand(p.astype(float)))
    broken = [None, b"", b"hello", jpeg(), files[0][:200], png(np.zeros((40, 40, 1)), 0, cut=12), files[0][:33] + files[0][40:]]
    rows = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate([*files, *broken])], "id int, content binary")
    got = media.hashes(rows).orderBy("id").collect()
    assert [f"{int(r.phash, 16):064b}" for r in got[:4]] == bits and all(r.phash is None and r.dhash is None and r.h is None for r in got[4:])
    assert all(int(r.phash, 16) == r.h % (1 << 64) for r in got[:4])
    flat = np.tile(np.arange(0, 90, dtype=np.uint8), (16, 1))
    assert media.picture_hashes(png(flat[:, :, None], 0))[1] == "f" * 16 and media.picture_hashes(png(flat[:, ::-1, None].copy(), 0))[1] == "0" * 16


def test_near_copies_are_found(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(12):
        p = np.kron(rng.uniform(10, 245, (9, 12)), np.ones((10, 10)))
        for copy in range(2):
            noisy = np.clip(p + rng.normal(0, 2, p.shape) * copy, 0, 255)
            shown = noisy[::2, ::2] if copy else noisy  # half the size, with noise
            rows.append((2 * k + copy, bytearray(png(np.repeat(shown.astype(np.uint8)[:, :, None], 3, axis=2), 2, filters=(1,)))))
    files = spark.createDataFrame(rows, "id long, content binary").repartition(3)
    pairs = {(r.id_a, r.id_b) for r in dedup.hamming_pairs(media.hashes(files).select("id", "h"), 8).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(12)} <= pairs and len(pairs) < 20


def test_binary_files(spark, tmp_path):
    (tmp_path / "a'b").mkdir()
    (tmp_path / "a'b/x.jpg").write_bytes(jpeg(tiff()))
    (tmp_path / "a'b/y.png").write_bytes(png(np.zeros((4, 4, 3))))
    files = spark.read.format("binaryFile").load(str(tmp_path / "a'b"))
    got = {r.path.rsplit("/", 1)[1]: (r.format_real, r.width, r.device_make) for r in media.read_media(files).collect()}
    assert got == {"x.jpg": ("JPEG", 40, "Canon"), "y.png": ("PNG", 4, None)}
    assert media.hashes(files).where(F.col("phash").isNotNull()).count() == 1
