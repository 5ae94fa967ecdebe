"""Secret scans: keywords first, then patterns anchored at the hits, then embedded checksums."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what the scan looks for, in the order in which spans of one start are listed
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
PATTERNS = {
    "assign": re.compile(
        rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
}
ASSIGNED, ACCESS, HEX = 6, 20, 24  # characters of an assigned value, an access key, a hex run, at least
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHECKED = 6  # last characters of a token that hold the checksum of the others
ROWS = 256  # texts scanned together
SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_SCANNER: list[ahocorasick.Automaton] = []


def _scanner() -> ahocorasick.Automaton:
    if not _SCANNER:
        automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                automaton.add_word(word, (kind, len(word)))
        automaton.make_automaton()
        _SCANNER.append(automaton)
    return _SCANNER[0]


def checksum(body: bytes) -> bytes:
    """The CRC-32 of a token's random part in base 62, six digits."""
    value, digits = zlib.crc32(body), ""
    for _ in range(CHECKED):
        value, digit = divmod(value, len(DIGITS))
        digits = DIGITS[digit] + digits
    return digits.encode()


def _holds(kind: str, match: re.Match) -> bool:
    """Whether a match is long enough, or its embedded checksum is right."""
    if kind == "assign":
        return match.end(1) - match.start(1) >= ASSIGNED
    if kind == "access":
        return match.end() - match.start() >= ACCESS
    token = match.group(1)
    return token[-CHECKED:] == checksum(token[:-CHECKED])


def scan(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of every span of each text, sorted, in bytes; kinds by number.

    All texts are scanned in one pass each for keywords and for runs of hex digits.  A pattern is
    tried only where a keyword starts and no earlier match of its kind has ended later, which
    finds the leftmost matches that do not overlap.
    """
    joined = b"\n".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = starts + sizes
    places = starts.tolist()
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    passed = dict.fromkeys(KEYWORDS, 0)
    for last, (kind, size) in _scanner().iter(joined.lower().decode("latin-1")):
        at = last + 1 - size
        if at < passed[kind]:
            continue
        row = bisect_right(places, at) - 1
        match = PATTERNS[kind].match(joined, at, int(ends[row]))
        if match:
            passed[kind] = match.end()
            if _holds(kind, match):
                found[row].append((at - places[row], KINDS.index(kind), match.end() - places[row]))
    data = np.frombuffer(joined, dtype=np.uint8)
    other = np.concatenate([[-1], np.flatnonzero(~_HEX[data]), [len(data)]])
    for i in np.flatnonzero(np.diff(other) > HEX):
        start, end = int(other[i]) + 1, int(other[i + 1])
        row = bisect_right(places, start) - 1
        found[row].append((start - places[row], KINDS.index("hex"), end - places[row]))
    return [sorted(spans) for spans in found]


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Spans by code points instead of bytes."""
    if not spans:
        return []
    starts = np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    return [{"kind": KINDS[kind], "start": int(np.searchsorted(starts, a)), "end": int(np.searchsorted(starts, b))}
            for a, kind, b in spans]


def _scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in parts:
        for a in range(0, part.num_rows, ROWS):
            few = part.slice(a, ROWS)
            texts = [t or b"" for t in few.column(1).cast(pa.large_binary()).to_pylist()]
            spans = [in_code_points(t, s) for t, s in zip(texts, scan(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array(spans, kind)], names=["id", "spans"])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, spans``: one row per row of ``docs``; every span with its kind, start and end.

    Starts and ends are code points, ends exclusive; spans are ordered by start, then by the order
    of KINDS.  Of each kind matches are leftmost and do not overlap; those too short are dropped
    after they were passed over.  Values assigned to a keyword (letters of it in either case, A-Z
    only), access keys and runs of lower-case hex digits count by their length; the tokens of two
    code hosts carry a checksum and count only if it is right.  Matches never leave their text.  Null and
    empty texts have no spans; repeated rows give repeated results, an empty table none.

    One automaton pass over the lower-cased bytes finds all keywords; patterns are tried at those
    places only.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(_scanned, f"id {dict(docs.dtypes)[doc_id]}, spans {SPAN}")
