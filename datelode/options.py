"""Options of a run, with their defaults, and the parsing of the few that are texts."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

#: Extensions that a scan skips unless told otherwise.
SKIPPED: frozenset[str] = frozenset()
MODES = ("no", "sha1", "phash", "clip")


def parse_skip(raw: str, default: frozenset[str] = SKIPPED) -> frozenset[str]:
    """'a,b' adds to the default, '=a,b' replaces it, '' keeps it; blanks and case do not count."""
    names = frozenset(x.strip().lower() for x in raw.removeprefix("=").split(",") if x.strip())
    return names if raw.startswith("=") else default | names


def run_prefix(input_dir: str, now: datetime | None = None) -> str:
    """Name for a run's files: time, then the folder's name with odd characters replaced."""
    stamp = (now or datetime.now()).strftime("%Y%m%d%H%M%S")
    name = input_dir.rstrip("/").rsplit("/", 1)[-1]
    return stamp + ("_" + "".join(c if c.isalnum() or c in "-_." else "_" for c in name or "root") if input_dir else "")


@dataclass(frozen=True)
class Options:
    input_dir: str = ""
    export_dir: str = ""
    confidence_threshold: float = 0.6
    dedup: str = "sha1"
    hamming: int = 4
    clip: bool = False
    min_cosine: float = 0.85
    neighbours: int = 5
    skip: frozenset[str] = field(default_factory=lambda: SKIPPED)
    live_photos: bool = False
    mine: bool = True
    gap_hours: float = 6.0
    anchor_confidence: float = 0.6
    min_train_confidence: float = 0.85
    validation: float = 0.1
    test: float = 0.1
    max_length: int = 64

    def __post_init__(self) -> None:
        if self.dedup not in MODES:
            raise ValueError(f"dedup must be one of {MODES}")
