"""Files as byte ranges, for data sources that Spark's own readers don't cover. Any store that pyarrow opens will do."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

READ_BYTES = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


def listed(path: str, suffix: str) -> list[fs.FileInfo]:
    """The file, or the files of a folder and of those in it whose names end so; in order of their paths."""
    store, at = opened(path)
    (info,) = store.get_file_info([at])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)), key=lambda f: f.path)


@dataclass(frozen=True)
class Range:
    """Bytes of a file from start to before end."""

    path: str
    start: int
    end: int


def ranges(path: str, start: int, size: int, step: int) -> list[Range]:
    return [Range(path, at, min(at + step, size)) for at in range(start, size, step)]


def lines(store: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """Place and bytes (without the line end) of each line that begins in the range; the last may go beyond it."""
    with store.open_input_file(part.path) as f:
        at = part.start
        if at:  # a line that begins here follows a line end
            f.seek(at - 1)
            ahead = f.read(1)
            while ahead and not ahead.endswith(b"\n"):
                ahead = f.read(READ_BYTES)
                cut = ahead.find(b"\n")
                if cut >= 0:
                    at, ahead = at + cut + 1, b"\n"
                else:
                    at += len(ahead)
            f.seek(at)
        rest = b""
        while at < part.end:
            more = f.read(READ_BYTES)
            pieces = (rest + more).split(b"\n")
            rest = pieces.pop()
            for piece in pieces:
                if at >= part.end:
                    return
                yield at, piece.removesuffix(b"\r")
                at += len(piece) + 1
            if not more:
                if rest and at < part.end:
                    yield at, rest.removesuffix(b"\r")
                return


def line_number(store: fs.FileSystem, path: str, at: int) -> int:
    """The number, from 1, of the line that begins there: read only to name a line in an error."""
    count = 1
    with store.open_input_file(path) as f:
        while at > 0 and (data := f.read(min(READ_BYTES, at))):
            count += data.count(b"\n")
            at -= len(data)
    return count
