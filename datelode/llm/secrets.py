"""Secret scans: fixed patterns, and strings that zstandard cannot compress.

Base spans are leftmost matches of three patterns, each kind by itself: `assign` (a name such as
password or api_key, a sign, a value of 6 characters or more), `access` (AKIA and capitals, 20 characters
or more) and `hex` (24 lower-case hex digits or more).

Novelty adds spans of kind `novel`. A candidate is a run of MIN_LENGTH characters or more of
[A-Za-z0-9+/_.-], padded by = or not, with letters and a digit or letters of both cases (a plain word is none), outside
base spans, in a sensitive context: a word of SENSITIVE stands on its line in the REACH code points before it. Its marginal bytes are what zstandard needs for the
surrounding code with the candidate less what it needs for the surrounding code alone. The compressor
is primed with a dictionary of identifiers: fixed ones of programs, and the words that stand in sensitive
contexts of the most documents of the corpus. Names, paths and prose are in the dictionary or around
them and cost little; a string of random letters costs about a byte a character. Candidates that cost
SHARE bytes a character or more are reported. Repetitions of the candidate are taken out of what
surrounds it, so a secret that stands twice is as new as one that stands once.

The dictionary is a report of the corpus' top words: counted in all documents, DICTIONARY of them kept, so
its size is bounded. Both passes are maps over the texts; only words of contexts are shuffled.

A document in which no pattern can start is told by one automaton over its bytes. Null and empty texts
have no spans; repeated rows each get their row; other columns are dropped by the report; an empty
table gives an empty result. Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import beside, column, doc_bytes, slices

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "novel"]
#: Words that make what follows them sensitive.
SENSITIVE = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key", "private key", "credential", "authorization", "bearer", "signature", "session_id", "cookie", "connectionstring", "sas_key", "client_id", "encryption_key", "signing_key"]
#: Identifiers that programs and settings have around secrets.
IDENTIFIERS = (
    "access account algorithm application argument array assert async authentication await basic boolean bucket bytes certificate class client cluster command config connection console const constructor content context control "
    "database debug default define delete description device digest directory document domain email enable endpoint environment error example except export expires extends false filename final format from function generate getenv "
    "global grant handler header hostname http https identifier implements import include index insert instance integer interface internal issuer json lambda length license local localhost logger login message method module "
    "namespace network none null number object option organization output override package parameter path payload permission placeholder policy port print private production profile project property protected protocol provider public "
    "query random readonly record refresh region register release remote request require resource response return role sample schema scope select self server service session setting static storage string struct subject sudo system "
    "table target template tenant test throw timeout true type undefined update upload user username value variable vector version void volume webhook window workspace www your xxxxxxxx changeme"
)
MIN_LENGTH, REACH, SHARE = 12, 48, 0.75
#: A word enters the dictionary from so many documents on.
MIN_DOCS = 10
#: Code points around a candidate that are compressed with it, words taken from the corpus, level of compression.
BEFORE, AFTER, DICTIONARY, LEVEL = 160, 80, 4096, 9
LEAD, TAIL = 256, 16  # bytes

_RUN = re.compile(rf"[A-Za-z0-9+/_.-]{{{MIN_LENGTH},}}={{0,2}}")
_SENSITIVE = re.compile("(?ai:" + "|".join(map(re.escape, SENSITIVE)) + ")")
_LETTER, _MIXED = re.compile("[A-Za-z]"), re.compile("[0-9]|[a-z][A-Z]")
_WORD = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z]{3,20}(?![A-Za-z0-9+/_-])")
#: What a text must have for a span of any kind.
_ANY = "(?i:api_?key|" + "|".join(map(re.escape, SENSITIVE)) + ")|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of runs within reach of a sensitive word before them, outside the spans taken."""
    out, words, near, k, covered = [], _SENSITIVE.finditer(text), -1, 0, 0
    word = next(words, None)
    for m in _RUN.finditer(text):
        start, end = m.span()
        while word and word.end() <= start:
            near, word = word.end(), next(words, None)
        while k < len(taken) and taken[k][0] < end:
            covered, k = max(covered, taken[k][2]), k + 1
        if near >= 0 and start - near <= REACH and text.find("\n", near, start) < 0 and covered <= start and _LETTER.search(text, start, end) and _MIXED.search(text, start, end):
            out.append((start, end))
    return out


def dictionary(words: list[str]) -> bytes:
    """The most usual words last, where zstandard reaches them at least cost."""
    return " ".join([*reversed(words), *IDENTIFIERS.split(), *SENSITIVE]).encode()


@cache
def _compressor(content: bytes):
    """One a worker process."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=primed, write_checksum=False, write_content_size=False)


def marginal_bytes(text: str, start: int, end: int, content: bytes) -> int:
    """Bytes that the string from start to end adds to its compressed surroundings.

    Pieces of the dictionary go before and behind them: a block that saves too little would be stored as it is,
    and the last bytes of a block are never matched.
    """
    string = text[start:end]
    before, after = text[max(0, start - BEFORE) : start].replace(string, ""), text[end : end + AFTER].replace(string, "")
    size = lambda s: len(_compressor(content).compress(content[-LEAD:] + s.encode() + content[-TAIL:]))
    return size(before + string + after) - size(before + after)


def spans(text: str, content: bytes, share: float = SHARE) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) in order."""
    base = base_spans(text)
    novel = [(a, 3, b) for a, b in candidates(text, base) if marginal_bytes(text, a, b, content) >= share * (b - a)]
    return sorted(base + novel)


def _texts(bodies: pa.Array) -> Iterator[tuple[int, str]]:
    """(place, text) of the texts that can have a span."""
    for i in pc.indices_nonzero(pc.match_substring_regex(bodies.cast(pa.large_string()), _ANY)).to_pylist():
        yield i, bodies[i].as_py().decode()


def context_words(docs: DataFrame, words: int = DICTIONARY, min_docs: int = MIN_DOCS) -> list[str]:
    """Words within reach of sensitive words, both sides, by the number of documents; the first `words` of min_docs or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "body"):
                found: Counter[str] = Counter()
                for _, text in _texts(rows.column("body")):
                    around = (text[max(0, m.start() - REACH) : m.end() + REACH] for m in _SENSITIVE.finditer(text))
                    found.update({w for piece in around for w in _WORD.findall(piece)})
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

    counts = doc_bytes(docs).select("body").mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("docs"))
    return [r.word for r in counts.where(F.col("docs") >= min_docs).orderBy(F.desc("docs"), "word").limit(words).collect()]


def secrets(docs: DataFrame, share: float = SHARE, words: int = DICTIONARY) -> DataFrame:
    """docs with spans, an array of (kind, start, end) in code points, end exclusive; in place of a column of that name."""
    content = docs.sparkSession.sparkContext.broadcast(dictionary(context_words(docs, words)))

    def run(bodies: list[bytes]) -> list[pa.Array]:
        out: list[list[dict]] = [[] for _ in bodies]
        for i, text in _texts(pa.array(bodies, pa.binary())):
            out[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(text, content.value, share)]
        return [pa.array(out, _SPANS)]

    return beside(docs, [c for c in docs.columns if c.lower() != "spans"], run, "spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; what overlaps a span before it goes with that."""
    kept = secrets(docs, share)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out")))
    text = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.length("text"))))
    return kept.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).select(*map(column, docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans (kind:start:end, comma-joined)."""
    found = secrets(docs.select("doc_id", "text")).select("doc_id", "spans")
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
