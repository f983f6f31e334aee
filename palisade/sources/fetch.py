"""Feeds over HTTPS, on the driver: only named hosts, bounded, conditional, and tried again with care.

Nothing here runs without being asked to; a test passes an opener of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from palisade.functions.control import canonical
from palisade.functions.safefile import read_regular, write_private

SCHEMA = "palisade.source-provenance"


@dataclass(frozen=True)
class Policy:
    hosts: frozenset[str]
    most: int = 64 << 20
    timeout: float = 20.0
    attempts: int = 1
    backoff: float = 0.0
    longest_wait: float = 300.0

    def __post_init__(self) -> None:
        if not self.hosts or any(h != h.lower() or not h for h in self.hosts):
            raise ValueError("hosts are lower-case names")
        if self.most < 1 or self.timeout <= 0 or not 1 <= self.attempts <= 10 or self.backoff < 0 or self.longest_wait < 0:
            raise ValueError("a bound is out of range")

    def check(self, url: str) -> str:
        u = urlsplit(url)
        if u.scheme != "https" or u.username or u.password or (u.hostname or "").lower() not in self.hosts:
            raise ValueError("not an https url of an allowed host")
        return url


@dataclass(frozen=True)
class Answer:
    """What a server answered; path is where the body was written, null if nothing has changed."""

    url: str
    path: str | None
    size: int
    digest: str | None
    etag: str | None
    last_modified: str | None
    content_type: str | None


def retryable(status: int) -> bool:
    """Whether a status is worth another attempt (fixed values)."""
    return status in (408, 429) or 500 <= status < 600


def wait_of(retry_after: str | None, longest: float, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header, a number or a date, within bounds; null if it has none."""
    if not retry_after:
        return None
    try:
        wait = float(retry_after)
    except ValueError:
        try:
            wait = parsedate_to_datetime(retry_after).timestamp() - (time.time() if now is None else now)
        except (TypeError, ValueError):
            return None
    return min(max(wait, 0.0), longest)


class _SameHosts(HTTPRedirectHandler):
    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        return super().redirect_request(req, fp, code, msg, headers, self.policy.check(urljoin(req.full_url, newurl)))


def _parts(response: object, most: int) -> Iterator[bytes]:
    said = response.headers.get("Content-Length")
    if said is not None and not 0 <= int(said) <= most:
        raise ValueError("body too large")
    total = 0
    while part := response.read(1 << 16):
        total += len(part)
        if total > most:
            raise ValueError("body too large")
        yield part


def download(url: str, target: str, policy: Policy, *, etag: str | None = None, last_modified: str | None = None, opener: object = None, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """Writes a url's body to a file, whole or not at all, without holding it in memory."""
    at = Path(target)
    if at.is_symlink() or (at.exists() and not at.is_file()):
        raise ValueError("target is a link or no regular file")
    at.parent.mkdir(parents=True, exist_ok=True)
    headers = {"Accept": "application/json", "User-Agent": "palisade/1"} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    ask = opener or build_opener(_SameHosts(policy))
    for attempt in range(policy.attempts):
        wait = None
        fd, name = tempfile.mkstemp(prefix=f".{at.name}.", dir=at.parent)
        try:
            with open(fd, "wb") as out, ask.open(Request(policy.check(url), headers=headers), timeout=policy.timeout) as response:
                final, digest, size = policy.check(response.geturl()), hashlib.sha256(), 0
                for part in _parts(response, policy.most):
                    digest.update(part)
                    out.write(part)
                    size += len(part)
                out.flush()
                os.fsync(out.fileno())
                h = response.headers
            os.replace(name, at)
            return Answer(final, str(at), size, f"sha256:{digest.hexdigest()}", h.get("ETag"), h.get("Last-Modified"), h.get("Content-Type"))
        except HTTPError as e:
            if e.code == 304:
                return Answer(policy.check(e.geturl() or url), None, 0, None, e.headers.get("ETag"), e.headers.get("Last-Modified"), e.headers.get("Content-Type"))
            if not retryable(e.code):
                raise ConnectionError(f"status {e.code}") from e
            wait, last = wait_of(e.headers.get("Retry-After"), policy.longest_wait), e
        except (URLError, TimeoutError) as e:
            last = e
        finally:
            Path(name).unlink(missing_ok=True)
        if attempt + 1 < policy.attempts:
            sleep(policy.backoff * 2**attempt if wait is None else wait)
    raise ConnectionError("no attempt succeeded") from last


def fetch(url: str, policy: Policy, **options: object) -> tuple[Answer, bytes | None]:
    """A small body in memory; null if nothing has changed."""
    with tempfile.TemporaryDirectory() as folder:
        answer = download(url, f"{folder}/body", policy, **options)
        return answer, None if answer.path is None else Path(answer.path).read_bytes()


def provenance(source_id: str, requested: str, answer: Answer) -> dict:
    """Where a download came from, with a digest of itself."""
    out = {
        "schema": SCHEMA, "version": 1, "source_id": source_id, "status": "not_modified" if answer.path is None else "downloaded", "requested_url": requested, "final_url": answer.url,
        "etag": answer.etag, "last_modified": answer.last_modified, "content_type": answer.content_type, "payload_sha256": answer.digest,
    }
    return out | {"provenance_sha256": f"sha256:{hashlib.sha256(canonical(out)).hexdigest()}"}


def conditions(path: str) -> tuple[str | None, str | None]:
    """(etag, last_modified) of a provenance file whose digest holds."""
    d = json.loads(read_regular(path, 1 << 20, "provenance"))
    if not isinstance(d, dict) or d.get("schema") != SCHEMA or d.get("version") != 1:
        raise ValueError("not a provenance file")
    said = d.pop("provenance_sha256", None)
    if said != f"sha256:{hashlib.sha256(canonical(d)).hexdigest()}":
        raise ValueError("provenance was changed")
    return d["etag"], d["last_modified"]


def persist(source_id: str, requested: str, answer: Answer, payload: bytes, output: str, sidecar: str, most: int = 64 << 20) -> dict:
    """Writes a downloaded JSON body and its provenance."""
    if answer.path is None and answer.digest is None:
        raise ValueError("nothing has changed, so there is nothing to keep")
    if len(payload) > most or not isinstance(json.loads(payload), (dict, list)):
        raise ValueError("body is too large or no JSON document")
    out = provenance(source_id, requested, answer)
    write_private(output, payload)
    write_private(sidecar, canonical(out))
    return out
