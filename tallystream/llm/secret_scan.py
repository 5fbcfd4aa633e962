"""Secret scan: pattern matches plus random-looking strings found by their token efficiency.

Text that people write has many characters per token under a BPE vocabulary; random strings have few. Every run of
characters that keys are made of is encoded, and runs with too few characters per token are reported, after leaving out
known kinds of digests and identifiers (see ``KNOWN``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallystream.llm.bpe import codec

#: The base patterns and the least length of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: A run that could be a key or a token.
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
#: Whole runs that are known digests or identifiers: MD5 to SHA-512 in hex, UUIDs, decimal numbers. Words are left to the ratio.
KNOWN = re.compile(
    r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|[0-9+/_=-]+"
)
_ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}


class Scanner:
    """Finds the spans of one text: (start, kind, end) in code points, end exclusive."""

    def __init__(self, least: int = 20, ratio: float = 2.2):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex = re.compile(ACCESS), re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)  # a maximal run either way
        self.run = re.compile(RUN % least)
        self.least, self.ratio = least, ratio
        self.encode = codec().encoding.encode_ordinary

    def base(self, text: str) -> list[tuple[int, str, int]]:
        found = [(m.start(), "assign", m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), "access", m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(m.start(), "hex", m.end()) for m in self.hex.finditer(text)]
        return sorted(found, key=lambda s: (s[0], _ORDER[s[1]]))

    def random(self, text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        found, at = [], 0
        for m in self.run.finditer(text):
            start, b = m.start(), m.end()
            while at < len(taken) and taken[at][2] <= start:
                at += 1
            pieces, next_ = [], at  # what the base spans leave of the run
            while next_ < len(taken) and taken[next_][0] < b:
                s, _, e = taken[next_]
                pieces.append((start, s))
                start, next_ = max(start, e), next_ + 1
            for a, e in [*pieces, (start, b)]:
                run = text[a : min(e, b)]
                if len(run) >= self.least and not KNOWN.fullmatch(run) and len(run) < self.ratio * len(self.encode(run)):
                    found.append((a, "random", a + len(run)))
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
        base = self.base(text)
        return base, sorted(base + self.random(text, base), key=lambda s: (s[0], _ORDER[s[1]]))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", *, least: int = 20, ratio: float = 2.2) -> DataFrame:
    """Scan every whole text; by their token efficiency random strings of ``least`` characters or more are found.

    ``least``: characters of a run from which its token efficiency counts; ``ratio``: characters per token below which it is
    random. Returns per input row the key, ``base`` and ``spans``: arrays of (kind, start, end). Null and empty texts have no
    spans; a text of any length is scanned whole; repeated rows give repeated rows; spans that start together are sorted by kind;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least, ratio)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda found: [{"kind": k, "start": a, "end": b} for a, k, b in found]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                got = [scanner.scan(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([rows(b) for b, _ in got], span), pa.array([rows(s) for _, s in got], span)], [key, "base", "spans"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, base {span}, spans {span}")


def base_digest(spans: list[tuple[int, str, int]]) -> str:
    """SHA-256 of the spans written as kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
