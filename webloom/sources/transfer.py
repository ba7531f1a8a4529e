"""Fetching files and calling services, given a transport: what is tried again, how long to wait, and files that are whole or absent."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path


class ConnectTimeout(OSError):
    """No connection was made, so nothing was sent."""


@dataclass(frozen=True)
class Answer:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


def retry_delay(attempt: int, retry_after: str | None = None, most: float = 60.0) -> float:
    """Seconds to wait: what the service asks for, or 2 to the power of the attempt, never more than ``most``."""
    try:
        return min(most, max(0.0, float(retry_after)))
    except (TypeError, ValueError):
        return min(most, 2.0**attempt)


def may_retry(method: str, outcome: Answer | Exception) -> bool:
    """Reads are tried again after any failure of the connection or the service; calls that change something only if they surely did nothing."""
    reads = method == "GET"
    if isinstance(outcome, Exception):
        return isinstance(outcome, ConnectTimeout) or reads and isinstance(outcome, OSError)
    return outcome.status in (429, 503) or reads and outcome.status >= 500


def request(send: Callable[[str, str], Answer], method: str, url: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The answer of ``send(method, url)``, tried again as ``may_retry`` has it; another status than 2xx at the end is an error."""
    for attempt in range(attempts):
        try:
            outcome: Answer | Exception = send(method, url)
        except OSError as e:
            outcome = e
        if isinstance(outcome, Answer) and 200 <= outcome.status < 300:
            return outcome
        if attempt + 1 == attempts or not may_retry(method, outcome):
            break
        sleep(retry_delay(attempt, outcome.headers.get("Retry-After") if isinstance(outcome, Answer) else None))
    if isinstance(outcome, Exception):
        raise outcome
    raise OSError(f"{method} {url}: status {outcome.status}")


def download(send: Callable[[str, str], Answer], url: str, path: str | Path, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> Path:
    """The file at ``path``, fetched if it isn't there; it gets its name only once it is whole."""
    path = Path(path)
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(path.name + ".part")
        part.write_bytes(request(send, "GET", url, attempts, sleep).body)
        os.replace(part, path)
    return path


def download_all(send: Callable[[str, str], Answer], files: Iterable[tuple[str, str]], threads: int = 8, **options) -> list[Path]:
    """All (url, path), some at a time, in the given order; the first failure is raised after the others are done."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(download, send, url, path, **options) for url, path in files]]
