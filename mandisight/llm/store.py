"""Files of the operators' own formats, in any store that pyarrow can reach.

Paths are URIs (``file:///...``, ``hdfs://...``) or plain local paths under
the shared folder. A writer task always makes a new file and names it in the
rows it returns, so a task that ran twice leaves an unnamed file, never a
mixed one.
"""

from __future__ import annotations

import functools

from pyarrow import fs


@functools.cache
def _system(scheme_root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(scheme_root)[0]


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return _system("file:///"), uri
    system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not
                                          uri.startswith("file://") else uri)
    return system, path


def create(uri: str):
    """A new binary file; the folders above it are made."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_random(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)


def coalesce(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, list[int]]]:
    """Merge sorted (offset, length) ranges whose gap is at most ``gap`` bytes into
    runs of at most ``most`` bytes (a longer single range stays whole);
    returns (offset, length, positions of the ranges in the run)."""
    runs: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if runs:
            start, held, members = runs[-1]
            end = max(start + held, offset + length)
            if offset - (start + held) <= gap and end - start <= most:
                runs[-1] = (start, end - start, [*members, i])
                continue
        runs.append((offset, length, [i]))
    return runs
