"""Time evidence: one row for each hypothesis about an item, from metadata, names, folders and the file system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelode.functions import paths
from datelode.functions.patterns import Pattern, match_all
from datelode.functions.timeparts import precision_rank

# Extensions whose files can hold metadata, and the confidence of each source.
METADATA_EXTENSIONS = ["jpg", "jpeg", "tiff", "tif", "heic", "heif", "avif", "raw", "cr2", "cr3", "nef", "arw", "orf", "rw2", "dng", "png", "webp"]
ORIGINAL, DIGITIZED, MODIFIED, FILE_SYSTEM = 1.0, 0.9, 0.6, 0.2
FOLDER_DISCOUNT, FOLDER_DECAY = 0.85, [1.0, 0.85, 0.7]

COLUMNS = ["item_id", "ev_seq", "source", "dt", "precision", "confidence", "is_direct", "pattern_name", "matched_text", "folder_name"]


TYPES = dict(zip(COLUMNS[1:], ("int", "string", "timestamp_ntz", "string", "double", "boolean", "string", "string", "string"), strict=True))


def _entry(**columns: Column) -> Column:
    """One piece of evidence as a struct; what is not given is null."""
    return F.struct(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in TYPES.items()])


def _if(condition: Column, entries: Column) -> Column:
    """entries where condition holds, else none."""
    return F.filter(entries, lambda e: condition & e["dt"].isNotNull())


def _emit(items: DataFrame, *lists: Column) -> DataFrame:
    """COLUMNS for every entry of the lists of each item: one pass over items, nothing is shuffled."""
    return items.select("item_id", F.explode(F.concat(*lists)).alias("e")).select("item_id", *[f"e.{c}" for c in COLUMNS[1:]])


def _has_metadata() -> Column:
    return F.col("ext").isin(METADATA_EXTENSIONS) & ~F.col("unsupported")


def _times(items: DataFrame) -> list[tuple[str, float, int]]:
    return [(c, conf, k) for k, (c, conf) in enumerate((("exif_original", ORIGINAL), ("exif_digitized", DIGITIZED), ("exif_modify", MODIFIED))) if c in items.columns]


def _exif(items: DataFrame) -> Column:
    return _if(_has_metadata(), F.array(*[_entry(ev_seq=F.lit(k), source=F.lit("exif"), dt=F.col(c), precision=F.lit("second"), confidence=F.lit(conf), is_direct=F.lit(True)) for c, conf, k in _times(items)]))


def _filesystem(items: DataFrame) -> Column:
    bare = _has_metadata() & F.coalesce(*[F.col(c) for c, _, _ in _times(items)]).isNull()
    return _if(bare, F.array(_entry(ev_seq=F.lit(3), source=F.lit("filesystem"), dt=F.col("mtime"), precision=F.lit("second"), confidence=F.lit(FILE_SYSTEM), is_direct=F.lit(False))))


def _filename(patterns: list[Pattern] | None) -> Column:
    keep = ("dt", "precision", "confidence", "pattern_name", "matched_text")
    return _if(~F.col("unsupported"), F.transform(match_all(F.coalesce("stem", F.lit("")), patterns), lambda m, k: _entry(ev_seq=100 + k, source=F.lit("filename"), is_direct=F.lit(True), **{c: m[c] for c in keep})))


def _foldername(patterns: list[Pattern] | None) -> Column:
    decay = F.array(*map(F.lit, FOLDER_DECAY))

    def one(name: Column, depth: Column) -> Column:
        def entry(m: Column, k: Column) -> Column:
            precision = F.when(precision_rank(m["precision"]) > 3, F.lit("day")).otherwise(m["precision"])
            return _entry(ev_seq=1000 * (depth + 1) + k, source=F.lit("foldername"), dt=m["dt"], precision=precision, confidence=F.round(m["confidence"] * FOLDER_DISCOUNT * F.get(decay, depth), 3), is_direct=F.lit(False), pattern_name=m["pattern_name"], matched_text=m["matched_text"], folder_name=name)

        return F.transform(match_all(name, patterns), entry)

    return _if(~F.col("unsupported"), F.flatten(F.transform(paths.nearest_folders(F.coalesce("path", F.lit(""))), one)))


def exif_evidence(items: DataFrame) -> DataFrame:
    """Up to three direct rows an item: original, digitized and modified time."""
    return _emit(items, _exif(items))


def filesystem_evidence(items: DataFrame) -> DataFrame:
    """The modification time, indirect and weak, where no metadata time is there."""
    return _emit(items, _filesystem(items))


def filename_evidence(items: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """One direct row for each pattern match in the stem."""
    return _emit(items, _filename(patterns))


def foldername_evidence(items: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """Indirect rows for matches in the three nearest folders; weaker with distance, at most day precision."""
    return _emit(items, _foldername(patterns))


def all_evidence(items: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """The bag union of the four emitters in one pass over items; nothing is shuffled."""
    return _emit(items, _exif(items), _filesystem(items), _filename(patterns), _foldername(patterns))
