"""Landing of remote files before a job reads them. Runs on one machine, outside of Spark."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from itertools import count
from pathlib import Path
from typing import TypeVar

Row = TypeVar("Row")


def download(url: str, path: str | Path, attempts: int = 5, wait: float = 1.0, block: int = 1 << 20) -> Path:
    """Fetches a file. A part of it that is there is resumed; a server that ignores the range starts it anew; a length
    that differs from what was announced counts as a failed attempt. The name appears when the file is whole."""
    path = Path(path)
    if path.exists():
        return path
    part = path.with_name(path.name + ".part")
    for attempt in range(attempts):
        have = part.stat().st_size if part.exists() else 0
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                resumed = answer.status == 206
                announced = answer.headers.get("Content-Length")
                want = int(announced) + (have if resumed else 0) if announced else None
                with part.open("ab" if resumed else "wb") as out:
                    while data := answer.read(block):
                        out.write(data)
            if want is None or part.stat().st_size == want:
                os.replace(part, path)
                return path
        except urllib.error.HTTPError as e:
            if e.code == 416:  # the part is longer than the file
                part.unlink(missing_ok=True)
        except (urllib.error.URLError, OSError):
            pass
        if attempt + 1 < attempts:
            time.sleep(wait * 2**attempt)
    raise OSError(f"{url}: not whole after {attempts} attempts")


def paged(pages: Callable[[int], Iterable[Row]], is_old: Callable[[Row], bool]) -> Iterator[Row]:
    """Rows of a listing, newest first, page by page until one is old or a page is empty."""
    for number in count():
        rows = list(pages(number))
        if not rows:
            return
        for row in rows:
            if is_old(row):
                return
            yield row
