"""Small files on any file system that Spark reaches: read, listed, and written whole or not at all.

Paths are those of Hadoop; one without a scheme is on the default file system. Without a session a path is a local one. A file is
written under another name beside its place and then renamed there, so that no reader sees a part of it. ``write_once`` gives the
place to one of several writers: the others get ``FileExistsError``.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def _hadoop(path: str) -> tuple | None:
    """(JVM, file system, Hadoop path) where there is a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    return jvm, system, system.makeQualified(at)


def exists(path: str | Path) -> bool:
    found = _hadoop(str(path))
    return found[1].exists(found[2]) if found else Path(path).exists()


def read(path: str | Path) -> bytes:
    """The whole content of a small file."""
    found = _hadoop(str(path))
    if found is None:
        return Path(path).read_bytes()
    jvm, system, at = found
    if not system.exists(at):
        raise FileNotFoundError(str(path))
    stream = system.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(folder: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; none where there is no such folder."""
    found = _hadoop(folder)
    if found is None:
        return sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    _, system, at = found
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def write_once(path: str | Path, data: bytes, *, overwrite: bool = False) -> None:
    """Write a file that appears whole. Where it exists it is kept and ``FileExistsError`` raised, unless told otherwise."""
    found = _hadoop(str(path))
    if found is None:
        place = Path(path)
        place.parent.mkdir(parents=True, exist_ok=True)
        temp = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
        temp.write_bytes(data)
        _settle(str(temp), str(place), overwrite)
        return
    jvm, system, at = found
    if not overwrite and system.exists(at):
        raise FileExistsError(str(path))
    parent = at.getParent()
    system.mkdirs(parent)
    temp = jvm.org.apache.hadoop.fs.Path(parent, f".{at.getName()}.{uuid.uuid4().hex}")
    stream = system.create(temp, True)
    stream.write(bytearray(data))
    stream.close()
    if at.toUri().getScheme() == "file":  # renaming would replace a file there
        try:
            _settle(temp.toUri().getPath(), at.toUri().getPath(), overwrite)
        finally:
            system.delete(temp, False)
        return
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = SparkSession.getActiveSession().sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), SparkSession.getActiveSession()._jsc.hadoopConfiguration()).rename(temp, at, how)
    except Exception as error:  # the file system's own, by way of the gateway
        system.delete(temp, False)
        if not overwrite and system.exists(at):
            raise FileExistsError(str(path)) from error
        raise


def _settle(temp: str, place: str, overwrite: bool) -> None:
    """Give a local file its name; a link is made only where there is none of that name."""
    if overwrite:
        os.replace(temp, place)
        # a checksum of the former content would refuse the new one
        Path(place).with_name(f".{Path(place).name}.crc").unlink(missing_ok=True)
        return
    try:
        os.link(temp, place)
    finally:
        os.unlink(temp)


def delete(path: str) -> None:
    """Delete a file or a folder with all that is in it, where there is one."""
    found = _hadoop(path)
    if found:
        found[1].delete(found[2], True)


def rename(folder: str, place: str, *, overwrite: bool = False) -> None:
    """Give a folder its name. ``FileExistsError`` where there is one of that name, unless it is to be replaced."""
    _, system, at = _hadoop(folder)
    _, _, to = _hadoop(place)
    if overwrite:
        system.delete(to, True)
    if system.exists(to) or not system.rename(at, to):
        system.delete(at, True)
        raise FileExistsError(place)
