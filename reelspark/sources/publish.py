"""Files that appear whole, once: the commit markers of stored tables and objects."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder."""
    return pafs.FileSystem.from_uri(uri)


def names(fs: pafs.FileSystem, folder: str) -> list[str]:
    """Sorted names of the files in ``folder``; none where there is no such folder."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File and not f.base_name.startswith("."))


def _staged(fs: pafs.FileSystem, path: str, content: bytes) -> str:
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(content)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(own, "rb") as written:
            os.fsync(written.fileno())
    return own


def publish(fs: pafs.FileSystem, path: str, content: bytes) -> bool:
    """Whether ``path`` is now a file of ``content`` that this call made: False if there was one before.

    A local or mounted folder links the finished file, HDFS renames it, and both refuse a name that is
    taken. Other stores replace silently, so they are refused.
    """
    if isinstance(fs, pafs.LocalFileSystem):
        own = _staged(fs, path, content)
        try:
            os.link(own, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    if fs.type_name != "hdfs":
        raise ValueError(f"a {fs.type_name} folder cannot refuse a name that is taken")
    own = _staged(fs, path, content)
    try:
        fs.move(own, path)
        return True
    except OSError:
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(own)
        return False


def _moved(fs: pafs.FileSystem, own: str, path: str, size: int) -> None:
    try:
        fs.move(own, path)
    except OSError:
        if fs.get_file_info(path).size != size:
            raise
        fs.delete_file(own)


def replace(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """``path`` with ``content``, whole at any time; for writers that all have the same content."""
    _moved(fs, _staged(fs, path, content), path, len(content))


@contextmanager
def replacing(fs: pafs.FileSystem, path: str) -> Iterator[pa.NativeFile]:
    """As :func:`replace`, for content that is written piece by piece; nothing is left where that breaks off."""
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(own, compression=None, buffer_size=1 << 20) as out:
            yield out
            size = out.tell()
        if isinstance(fs, pafs.LocalFileSystem):
            with open(own, "rb") as written:
                os.fsync(written.fileno())
    except BaseException:
        fs.delete_file(own)
        raise
    _moved(fs, own, path, size)
