"""Files of the Python data sources, on any store that Arrow reads."""

from __future__ import annotations

import os

from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or local path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def files_below(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files of this suffix in a folder (hidden ones and
    those in hidden folders left out), or of the one file ``path``."""
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    seen = [f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix)]
    return sorted((f.path, f.size) for f in seen if not any(p[:1] in "_." for p in f.path[len(at):].strip("/").split("/")))
