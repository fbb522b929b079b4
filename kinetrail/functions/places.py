"""Paths and URIs: files on whatever file system Arrow reads."""

from __future__ import annotations

import os

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def file_info(path: str) -> fs.FileInfo:
    system, spot = file_system(path)
    return system.get_file_info(spot)


def is_file(path: str) -> bool:
    return file_info(path).type == fs.FileType.File
