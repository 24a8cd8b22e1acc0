"""Files by path or URI: local ones, and those of any store that Arrow's file systems know."""

from __future__ import annotations

import re

import pyarrow.fs as fs

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def has_scheme(path: str) -> bool:
    return bool(_SCHEME.match(path)) or path.startswith("file:/")


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it."""
    if has_scheme(path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*(?=/)", "file://", path))
    return fs.LocalFileSystem(), path


def info(path: str) -> fs.FileInfo:
    store, at = resolve(path)
    return store.get_file_info(at)


def read_bytes(path: str) -> bytes:
    store, at = resolve(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """Under another name first, so nobody reads a part of it."""
    store, at = resolve(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/.{name}") as f:
        f.write(data)
    store.move(f"{folder}/.{name}", at)


def below(folder: str) -> list[tuple[str, str, bool, int, int]]:
    """(path, name, is it a directory, size, modification time in ns) of a folder's entries, whose paths begin as the folder's does."""
    store, at = resolve(folder)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    base = folder.rstrip("/")
    return [(f"{base}/{f.base_name}", f.base_name, f.type is fs.FileType.Directory, f.size or 0, f.mtime_ns or 0) for f in found]
