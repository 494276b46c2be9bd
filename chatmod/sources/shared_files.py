"""Files under a shared folder, for readers that run in Python (stream planning and Python data sources).

Paths are as Spark names them (``file:///...``, ``hdfs://...``, ``s3://...`` or a plain local path)."""

from __future__ import annotations

from pyarrow import fs


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path therein)."""
    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files(path: str) -> list[fs.FileInfo]:
    """The files directly under ``path``, by name; none if there is no such folder."""
    system, folder = open_folder(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
