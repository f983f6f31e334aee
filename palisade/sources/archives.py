"""Archives: bounds that are checked before anything is unpacked, and advisories from ZIP files."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import stat
import struct
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Bounds:
    members: int = 100_000
    member_bytes: int = 128 << 20
    total_bytes: int = 512 << 20
    directory_bytes: int = 256 << 20


def directory_size(f: BinaryIO, bounds: Bounds) -> tuple[int, int]:
    """(members, bytes) that a ZIP's end record states for its central directory, checked against the
    bounds before the directory is read; several disks and contradictions are refused."""
    size = f.seek(0, io.SEEK_END)
    at = f.seek(max(0, size - 65_557))
    tail = f.read()
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) < end + 22:
        raise ValueError("no ZIP end record")
    disk, start_disk, here, members, length, offset, comment = struct.unpack_from("<4H2LH", tail, end + 4)
    if disk or start_disk or end + 22 + comment != len(tail):
        raise ValueError("several disks or a malformed end record")
    large = 0xFFFF in (here, members) or length == 0xFFFFFFFF
    before = tail[end - 20 : end] if end >= 20 else b""
    if before[:4] == b"PK\x06\x07":
        start_disk, record, disks = struct.unpack_from("<LQL", before, 4)
        f.seek(record)
        raw = f.read(56)
        if start_disk or disks != 1 or len(raw) != 56 or raw[:4] != b"PK\x06\x06":
            raise ValueError("malformed ZIP64 record")
        d1, d2, *wide = struct.unpack_from("<2L4Q", raw, 16)
        if d1 or d2 or (not large and tuple(wide) != (here, members, length, offset)):
            raise ValueError("ZIP64 record contradicts the end record")
        here, members, length, offset = wide
    elif large:
        raise ValueError("ZIP64 record is missing")
    if here != members or not 0 < members <= bounds.members or not 0 < length <= bounds.directory_bytes or offset + length > at + end:
        raise ValueError("central directory is out of bounds")
    f.seek(0)
    return members, length


def safe_name(name: str) -> bool:
    """Whether a member's name stays below the folder that it is unpacked into."""
    path = PurePosixPath(name)
    return bool(name) and len(name.encode()) <= 1024 and not path.is_absolute() and ".." not in path.parts and "\\" not in name and "\0" not in name


def check_member(info: zipfile.ZipInfo, most: int, suffix: str = "") -> None:
    if not safe_name(info.filename):
        raise ValueError("unsafe member name")
    if info.flag_bits & 1:
        raise ValueError("encrypted member")
    if stat.S_ISLNK(info.external_attr >> 16):
        raise ValueError("link in an archive")
    if not info.is_dir() and not info.filename.endswith(suffix):
        raise ValueError("unexpected member")
    if info.file_size > most:
        raise ValueError("member too large")


def zip_records(archives: DataFrame, bounds: Bounds = Bounds(), suffix: str = ".json") -> DataFrame:
    """(path, member, record, reject_reason) of ZIP files (path, content, as Spark's binaryFile reads
    them), a row a member in order of name; an archive out of bounds is one row with its reason."""

    def rows(path: str, raw: bytes) -> Iterator[tuple]:
        try:
            members, _ = directory_size(io.BytesIO(raw), bounds)
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                infos = sorted(z.infolist(), key=lambda i: i.filename)
                if len(infos) != members or len({i.filename for i in infos}) != members or sum(i.file_size for i in infos) > bounds.total_bytes:
                    raise ValueError("members disagree with the end record, repeat or are too large")
                for i in infos:
                    try:
                        check_member(i, bounds.member_bytes, suffix)
                        if not i.is_dir():
                            yield path, i.filename, z.read(i).decode("utf-8"), None
                    except (ValueError, UnicodeDecodeError, zipfile.BadZipFile) as e:
                        yield path, i.filename, None, str(e)
        except (ValueError, zipfile.BadZipFile, struct.error) as e:
            yield path, None, None, str(e)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                held: list[tuple] = []
                for r in rows(path, bytes(raw)):
                    held.append(r)
                    if len(held) == 200:
                        yield pd.DataFrame(held, columns=["path", "member", "record", "reject_reason"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "member", "record", "reject_reason"])

    return archives.select("path", "content").mapInPandas(read, "path string, member string, record string, reject_reason string")


def extract(archive: str, folder: str, bounds: Bounds = Bounds()) -> tuple[int, int]:
    """Unpacks a .zip, .tar(.gz, .bz2, .xz) or .gz file into a new folder, whole or not at all; returns (members, bytes)."""
    source, target = Path(archive), Path(folder)
    if source.is_symlink() or not source.is_file() or target.exists() or target.is_symlink():
        raise ValueError("the archive is missing or the folder is there")
    target.parent.mkdir(parents=True, exist_ok=True)
    work = Path(tempfile.mkdtemp(prefix=f".{target.name}.", dir=target.parent))
    members = total = 0

    def write(name: str, f: BinaryIO | None) -> None:
        nonlocal members, total
        if not safe_name(name):
            raise ValueError("unsafe member name")
        members += 1
        if members > bounds.members:
            raise ValueError("too many members")
        at = work / name
        if f is None:
            at.mkdir(parents=True, exist_ok=True)
            return
        at.parent.mkdir(parents=True, exist_ok=True)
        own = 0
        with open(at, "xb") as out:
            while part := f.read(1 << 16):
                own, total = own + len(part), total + len(part)
                if own > bounds.member_bytes or total > bounds.total_bytes:
                    raise ValueError("archive unpacks to too many bytes")
                out.write(part)

    try:
        name = source.name.lower()
        if name.endswith(".zip"):
            with open(source, "rb") as f:
                directory_size(f, bounds)
                with zipfile.ZipFile(f) as z:
                    for i in z.infolist():
                        check_member(i, bounds.member_bytes)
                        if i.is_dir():
                            write(i.filename, None)
                        else:
                            with z.open(i) as member:
                                write(i.filename, member)
        elif name.endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")):
            with tarfile.open(source) as t:
                for i in t:
                    if not (i.isdir() or i.isfile()):
                        raise ValueError("link or special file in an archive")
                    write(i.name, None if i.isdir() else t.extractfile(i))
        elif name.endswith(".gz"):
            with gzip.open(source) as f:
                write(source.name[:-3], f)
        else:
            raise ValueError("unknown kind of archive")
        os.rename(work, target)
    except Exception:
        shutil.rmtree(work, ignore_errors=True)
        raise
    return members, total


def extract_single(archive: str, target: str, member: str, size: int, digest: str, bounds: Bounds = Bounds(members=1)) -> None:
    """Unpacks the one member of a ZIP whose name, size and sha256: digest a signed manifest states."""
    import hashlib

    with open(archive, "rb") as f:
        if directory_size(f, bounds)[0] != 1:
            raise ValueError("more than one member")
        with zipfile.ZipFile(f) as z:
            (info,) = z.infolist()
            check_member(info, size)
            if info.is_dir() or info.filename != member or "/" in member or info.file_size != size:
                raise ValueError("member is not the stated one")
            h, at = hashlib.sha256(), Path(target)
            with z.open(info) as src, open(at.with_name(f".{at.name}.part"), "wb") as out:
                while part := src.read(1 << 20):
                    h.update(part)
                    out.write(part)
    part = at.with_name(f".{at.name}.part")
    if f"sha256:{h.hexdigest()}" != digest or part.stat().st_size != size:
        part.unlink()
        raise ValueError("content is not the stated one")
    os.replace(part, at)
