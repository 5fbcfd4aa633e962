"""Canonical JSON, digests, write-once documents and digest-verified ones, and records of tables."""

from __future__ import annotations

import gzip
import hashlib
import json
import platform
import re
from importlib import metadata
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.sources import files


def canonical(content: object) -> bytes:
    """Sorted keys, no spaces, UTF-8; NaN and infinities are refused."""
    return json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(content: object) -> str:
    return hashlib.sha256(canonical(content)).hexdigest().upper()


def file_digest(path: str | Path) -> str:
    """SHA-256 of a small file, wherever it is stored."""
    return hashlib.sha256(files.read(path)).hexdigest().upper()


def checked_digest(text: str) -> str:
    if not re.fullmatch(r"[0-9A-Fa-f]{64}", text):
        raise ValueError("not a SHA-256 digest")
    return text.upper()


def sealed(document: dict, field: str = "sha256") -> dict:
    """The document with the digest of all its other keys."""
    body = {k: v for k, v in document.items() if k != field}
    return body | {field: digest(body)}


def opened(document: dict, *, kind: str | None = None, version: int | None = None, field: str = "sha256") -> dict:
    """The document, after its digest, type and version were verified."""
    body = {k: v for k, v in document.items() if k != field}
    if checked_digest(str(document.get(field, ""))) != digest(body):
        raise ValueError("the document was changed after it was sealed")
    if kind is not None and document.get("type") != kind:
        raise ValueError(f"not a document of type {kind}")
    if version is not None and document.get("version") != version:
        raise ValueError(f"not version {version}")
    return document


def write_json(path: str | Path, document: dict, *, overwrite: bool = False) -> None:
    """Atomic and write-once, on any file system: the file appears whole or not at all, of several writers one succeeds, and an
    existing file is kept unless told otherwise. A name that ends in .gz is compressed."""
    data = json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False).encode()
    files.write_once(path, gzip.compress(data, mtime=0) if str(path).endswith(".gz") else data, overwrite=overwrite)


def read_json(path: str | Path) -> dict:
    data = files.read(path)
    out = json.loads(gzip.decompress(data) if str(path).endswith(".gz") else data)
    if not isinstance(out, dict):
        raise ValueError("the document must be an object")
    return out


def versions() -> dict[str, str]:
    """Versions that results may depend on."""
    out = {"python": platform.python_version()}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        out[name] = metadata.version(name)
    return out


def digest_parts(columns: list[str]) -> dict[str, Column]:
    """Aggregates that ``digest_of`` makes the SHA-256 of rows of: sums of the limbs of 60 bits of the rows' own digests."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    return {f"l{i}": F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)}


def digest_of(rows: int, parts: dict) -> str:
    return digest([rows, *[str(parts[f"l{i}"] or 0) for i in range(4)]])


def content_digest(df: DataFrame, columns: list[str]) -> tuple[int, str]:
    """(rows, SHA-256) of the rows as a multiset, whatever their order and partitions: digests of rows are added up, so no task
    gathers rows."""
    found = df.agg(F.count("*").alias("n"), *[c.alias(name) for name, c in digest_parts(columns).items()]).first()
    return found["n"], digest_of(found["n"], found.asDict())


def table_record(df: DataFrame, kind: str = "table") -> dict:
    """The sealed record of a table: its columns and types, rows and content."""
    rows, seal = content_digest(df, df.columns)
    return sealed({"type": kind, "version": 1, "columns": [list(c) for c in df.dtypes], "rows": rows, "content_sha256": seal, "versions": versions()})


def verified_table(df: DataFrame, record: dict, kind: str = "table") -> DataFrame:
    """``df``, after the record and the table's columns, rows and content were verified."""
    found = opened(record, kind=kind, version=1)
    if found["columns"] != [list(c) for c in df.dtypes]:
        raise ValueError("the table has other columns than its record")
    if (found["rows"], found["content_sha256"]) != content_digest(df, df.columns):
        raise ValueError("the table's rows are not those of its record")
    return df


def ordered_digest(df: DataFrame, key: str, time: str) -> str:
    """SHA-256 that depends on the keys and on their order by time: each key counts with its time, which fixes the order."""
    return content_digest(key_times(df, key, time), ["t", "k"])[1]


def key_times(df: DataFrame, key: str, time: str) -> DataFrame:
    return df.select(F.col(time).alias("t"), F.col(key).cast("string").alias("k"))
