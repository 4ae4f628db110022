"""Files by path or URI: local ones, and whatever file systems pyarrow knows (``hdfs://``, ``s3://`` and the like)."""

from __future__ import annotations

from pyarrow import fs


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_file(path: str):
    """A file for random access."""
    where, name = _located(path)
    return where.open_input_file(name)


def input_files(path: str) -> list[str]:
    """The file, or the files of a folder but hidden ones and marks; as URIs where ``path`` is one."""
    where, name = _located(path)
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != fs.FileType.Directory:
        return [path]
    found = where.get_file_info(fs.FileSelector(name))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.is_file and f.base_name[0] not in "._")
