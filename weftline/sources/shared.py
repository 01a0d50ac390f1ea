"""Small files in folders that driver and executors share: local, mounted or by a URI of any file system that Arrow knows."""

from __future__ import annotations

import os

from pyarrow import fs as arrow_fs


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return arrow_fs.LocalFileSystem(), os.path.abspath(path)
    return arrow_fs.FileSystem.from_uri(path)


def names(folder: str) -> list[str]:
    """Names of the files in a folder, sorted; none if there is no such folder."""
    system, at = located(folder)
    return sorted(f.base_name for f in system.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True)) if f.type == arrow_fs.FileType.File)


def read_bytes(path: str) -> bytes | None:
    """The whole file, or None if there is none."""
    system, at = located(path)
    if system.get_file_info(at).type == arrow_fs.FileType.NotFound:
        return None
    with system.open_input_stream(at) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """Write under another name and rename, so that the file is there whole or not at all."""
    system, at = located(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    with system.open_output_stream(f"{at}.tmp") as f:
        f.write(data)
    system.move(f"{at}.tmp", at)
