"""Files of the driver that are read and written with care: control documents and reports."""

from __future__ import annotations

import os
import stat
import tempfile
from pathlib import Path


def read_regular(path: str | os.PathLike[str], most: int, label: str = "input") -> bytes:
    """The bytes of a regular file of at most ``most`` bytes; neither it nor a folder above it may be a link."""
    at = Path(os.path.abspath(path))
    if any(p.is_symlink() for p in (at, *at.parents)):
        raise ValueError(f"{label}: a link is on the path")
    try:
        with open(os.open(at, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC), "rb") as f:
            info = os.fstat(f.fileno())
            if not stat.S_ISREG(info.st_mode) or info.st_size > most:
                raise ValueError(f"{label}: not a regular file of at most {most} bytes")
            raw = f.read(most + 1)
    except OSError as e:
        raise ValueError(f"{label}: cannot be read") from e
    if len(raw) > most:
        raise ValueError(f"{label}: grew beyond {most} bytes")
    return raw


def write_private(path: str | os.PathLike[str], payload: bytes, overwrite: bool = True) -> None:
    """Writes a file that only its owner reads, whole or not at all; without overwrite an existing one is an error."""
    at = Path(os.path.abspath(path))
    if at.is_symlink() or (at.exists() and not at.is_file()):
        raise ValueError("output is a link or no regular file")
    at.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(prefix=f".{at.name}.", dir=at.parent)  # 0600
    try:
        with open(fd, "wb") as f:
            f.write(payload)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(name, at)
        else:
            os.link(name, at)  # fails if it is there
    finally:
        Path(name).unlink(missing_ok=True)
