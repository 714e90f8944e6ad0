"""Files as tasks open them, wherever they lie."""

from __future__ import annotations

from typing import Any


def file_system(path: str) -> tuple[Any, str]:
    """The file system of an address or a plain path, and the place in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_below(path: str, ending: str) -> list[str]:
    """The files of a folder, however deep, or the one file a path names; in order."""
    from pyarrow import fs

    system, place = file_system(path)
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(head + i.path for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(ending))
