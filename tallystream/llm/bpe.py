"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until the parts are small, each part is encoded by itself, and neighbours are joined on the way up.
Joining two encoded parts keeps every token outside a window around the seam, and encodes only the window again. There are two
proofs that the tokens outside are final:

* The window ends, on both sides, at a *sure boundary*, a place where the splitting pattern ends a match whatever stands
  further away. Merges never cross such a place. Most seams have one within ``REACH`` characters.
* Else the seam lies within one long match (a run of letters, digits, other characters or white space). The window is some
  tokens on either side; it doubles until its first and last token are *compatible* with their neighbours outside, which means
  that the two alone are encoded as themselves. A sequence of tokens is the encoding of its bytes if and only if that holds of
  all neighbours in it, and inside the two parts it does.

Runs of characters that Unicode 3.2 did not know as letters or digits have no second proof: the window grows to the next sure
boundary. Joining is associative with the empty text as its unit; decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters up to which a part is encoded directly.
LEAF = 1024
#: Characters from a seam to look for a sure boundary before windows of tokens are tried; tokens of the first such window on each
#: side; characters of a run that must follow it (a contraction may take two of them into a match of its own).
REACH, TOKENS, MARGIN = 64, 8, 4
_SPACE = frozenset(" \t\n\r\v\f\x85")


@cache
def _kind(c: str) -> str | None:
    """L, N, S (white space) or O (any other), where a character is of that kind in every version of Unicode since 3.2."""
    now, old = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]
    if c in _SPACE:
        return "S"
    if c.isspace() or now in "LNZ":
        return {"L": "L", "N": "N", "Z": "S"}.get(now) if now == old else None
    return "O" if unicodedata.category(c) != "Cn" and old not in "LNZ" else None


def _sure(before: str, after: str) -> bool:
    """Whether a match of the pattern ends between these two characters in any text.

    No alternative has white space after another kind of character, a letter or digit before another kind, or a letter or digit
    after another kind than a space or the apostrophe of a contraction ('s, 're, ...).
    """
    a, b = _kind(before), _kind(after)
    if b == "S":
        return a != "S" and not before.isspace()
    if a in ("L", "N"):
        return b is not None and b != a
    return a == "O" and before != "'" and b in ("L", "N")


class TreeCodec:
    """Encoder and decoder for one rank file and the public splitting pattern, for which sure boundaries are proven."""

    def __init__(self, rank_file: str, pattern: str, leaf: int = LEAF):
        import public_tokenizers
        import tiktoken

        if pattern != public_tokenizers.PATTERN:
            raise ValueError("sure boundaries are not proven for this splitting pattern")
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.leaf = max(1, leaf)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.widths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def _leaf(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """Token ids (uint32) of the whole text."""
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of ``text[lo:hi]`` from those of its two parts."""
        a, b = self._before(text, max(lo, mid - REACH), mid, hi), self._after(text, lo, mid, min(hi, mid + REACH))
        if (a is None and mid - REACH > lo) or (b is None and mid + REACH < hi):
            joined = self._join_match(text, lo, mid, hi, left, right)
            if joined is not None:
                return joined
            a, b = self._before(text, lo, mid, hi), self._after(text, lo, mid, hi)
        a, b = lo if a is None else a, hi if b is None else b
        if a == b:
            return np.concatenate([left, right])
        keep = len(left) - self._count(left[::-1], len(text[a:mid].encode()))
        skip = self._count(right, len(text[mid:b].encode()))
        return np.concatenate([left[:keep], self._leaf(text[a:b]), right[skip:]])

    @staticmethod
    def _before(text: str, lo: int, mid: int, hi: int) -> int | None:
        """The last sure boundary from ``mid`` back to after ``lo``."""
        return next((i for i in range(mid, lo, -1) if i < hi and _sure(text[i - 1], text[i])), None)

    @staticmethod
    def _after(text: str, lo: int, mid: int, hi: int) -> int | None:
        """The first sure boundary from ``mid`` on to before ``hi``."""
        return next((i for i in range(mid, hi) if i > lo and _sure(text[i - 1], text[i])), None)

    def _join_match(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """The joined ids where the seam lies within one match, by growing windows of tokens; None where it ends too near."""
        k, kind = TOKENS, _kind(text[mid])
        while kind is not None and k < min(len(left), len(right)):
            # A token has at most as many characters as bytes; the tokens next to the window must be of the same match, too.
            start, end = mid - int(self.widths[left[-k - 1 :]].sum()) - MARGIN, mid + int(self.widths[right[: k + 1]].sum()) + MARGIN
            if start < lo or end > hi or any(_kind(c) != kind for c in text[start:end]):
                return None
            window = self._piece(b"".join(self.tokens[i] for i in (*left[-k:].tolist(), *right[:k].tolist())))
            if self._compatible(int(left[-k - 1]), window[0]) and self._compatible(window[-1], int(right[k])):
                return np.concatenate([left[:-k], np.array(window, dtype=left.dtype), right[k:]])
            k *= 2
        return None

    def _piece(self, data: bytes) -> list[int]:
        """The ids of bytes within one match."""
        return self.encoding._encode_single_piece(data)

    def _compatible(self, one: int, two: int) -> bool:
        """Whether two neighbouring tokens alone are encoded as themselves."""
        return self._piece(self.tokens[one] + self.tokens[two]) == [one, two]

    def _count(self, ids: np.ndarray, width: int) -> int:
        """How many of the first ids make up exactly ``width`` bytes."""
        if width == 0:
            return 0
        ends = np.cumsum(self.widths[ids[:width]])
        k = int(np.searchsorted(ends, width))
        if k >= len(ends) or ends[k] != width:
            raise AssertionError("a sure boundary lies inside a token")
        return k + 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: halves are decoded and concatenated."""
        if len(ids) <= 4 * self.leaf:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def codec(rank_file: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> TreeCodec:
    """The codec of this process; by default the public 50k byte-level vocabulary that is installed on every machine."""
    import public_tokenizers

    return TreeCodec(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, leaf)


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", *, rank_file: str | None = None, pattern: str | None = None, leaf: int = LEAF, keep_ids: bool = True) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns one row per input row: the key, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` and, with ``keep_ids``, ``ids`` (those bytes). A null or empty text has no tokens; repeated rows give
    repeated rows; null keys are kept; an empty table gives no rows; other columns are not read. A text of any length is handled
    whole, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern, leaf)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for value in part.column(1):
                    ids = c.encode(value.as_py() or "").astype("<u4", copy=False)
                    raw = ids.tobytes()
                    rows.append((len(ids), sha(raw), sha(c.decode(ids)), raw))
                cols = list(zip(*rows, strict=True))
                out = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out, names = [*out, pa.array(cols[3], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(key, text).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", *, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``decoded`` (binary) for a column of little-endian unsigned 32-bit ids; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            out = [None if r is None else c.decode(np.frombuffer(r, dtype="<u4")) for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))
