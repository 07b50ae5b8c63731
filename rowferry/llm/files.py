"""Files that executors write and read themselves, on whatever store the shared folder is."""

from __future__ import annotations

import re

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a URI or an absolute path."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def create(path: str):
    """An output stream to a new file, written as it comes; missing folders are made."""
    system, inner = resolve(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_input(path: str):
    system, inner = resolve(path)
    return system.open_input_file(inner)
