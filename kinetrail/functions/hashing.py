"""File fingerprints."""

from __future__ import annotations

from pyarrow import fs

from .places import file_system

# Fixed values of the fingerprint: its start (one digit shorter than the standard basis) and its prime.
START, PRIME = 1469598103934665603, 1099511628211


def fnv1a(data: bytes, h: int = START) -> int:
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def hex16(h: int) -> str:
    return f"{h:016x}"


def file_fingerprint(path: str) -> str:
    """Of a file's bytes, or those of a folder's files one after the other, in order of their names."""
    h = START
    system, spot = file_system(path)
    found = [spot]
    if system.get_file_info(spot).type == fs.FileType.Directory:
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(spot)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    for name in found:
        with system.open_input_stream(name) as f:
            while part := f.read(1 << 16):
                h = fnv1a(part, h)
    return hex16(h)
