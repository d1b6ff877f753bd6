"""File operations that tasks run against any filesystem pyarrow knows by URI."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import TypeVar

from pyarrow import fs as pafs

T = TypeVar("T")

TEMP_PREFIX = ".sealroute-"
BLOCK_BYTES = 8 << 20
# Stores where a finished upload replaces the object in one step.
ATOMIC_PUT = {"s3", "gcs", "abfs"}


@lru_cache(maxsize=64)
def _filesystem(prefix: str) -> tuple[pafs.FileSystem, str]:
    if "://" in prefix or prefix.startswith("file:"):
        return pafs.FileSystem.from_uri(prefix)
    return pafs.LocalFileSystem(), prefix


def locate(root: str | None, path: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and inner path of ``path`` below ``root``; without a root the path stands alone."""
    if root:
        filesystem, base = _filesystem(root.rstrip("/"))
        return filesystem, f"{base}/{path}"
    return _filesystem(path)


def walk(
    filesystem: pafs.FileSystem, folder: str, recursive: bool, temporary: bool = False
) -> Iterator[pafs.FileInfo]:
    """Entries below ``folder``, one directory listing at a time, hidden and empty files included.

    What running jobs have staged is left out unless ``temporary``.
    """
    pending = [folder]
    while pending:
        current = pending.pop()
        for info in filesystem.get_file_info(pafs.FileSelector(current, recursive=False)):
            if info.base_name.startswith(TEMP_PREFIX) and not temporary:
                continue
            yield info
            if recursive and info.type == pafs.FileType.Directory:
                pending.append(info.path)


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def exists(filesystem: pafs.FileSystem, path: str) -> bool:
    return filesystem.get_file_info(path).type != pafs.FileType.NotFound


def _replace(filesystem: pafs.FileSystem, source: str, target: str) -> None:
    try:
        filesystem.move(source, target)
    except OSError:
        # Some stores refuse to rename onto an existing file.
        if not exists(filesystem, source) or not exists(filesystem, target):
            raise
        filesystem.delete_file(target)
        filesystem.move(source, target)


def _in_folder_of(filesystem: pafs.FileSystem, path: str, action: Callable[[], T]) -> T:
    """Run an action that puts something at ``path``; create its folder only if that is missing."""
    try:
        return action()
    except FileNotFoundError:
        if not _parent(path):
            raise
        filesystem.create_dir(_parent(path), recursive=True)
        return action()


def write_file(filesystem: pafs.FileSystem, path: str, data: bytes | Iterable[bytes]) -> None:
    """Write a whole file, replacing an older one; a reader never sees a half-written file."""
    atomic = filesystem.type_name in ATOMIC_PUT
    written = path if atomic else f"{_parent(path)}/{TEMP_PREFIX}{uuid.uuid4().hex}"
    try:
        with _in_folder_of(filesystem, path, lambda: filesystem.open_output_stream(written)) as out:
            for block in [data] if isinstance(data, bytes) else data:
                out.write(block)
        if not atomic:
            _replace(filesystem, written, path)
    except BaseException:
        if not atomic and exists(filesystem, written):
            filesystem.delete_file(written)
        raise


def _blocks(filesystem: pafs.FileSystem, path: str) -> Iterator[bytes]:
    with filesystem.open_input_stream(path) as source:
        while block := source.read(BLOCK_BYTES):
            yield block


def same_bytes(filesystem: pafs.FileSystem, one: str, two: str) -> bool:
    """Whether two files hold the same, read a block at a time and only if their sizes agree."""
    sizes = {info.size for info in filesystem.get_file_info([one, two])}
    return len(sizes) == 1 and all(a == b for a, b in zip(_blocks(filesystem, one), _blocks(filesystem, two)))


def read_file(filesystem: pafs.FileSystem, path: str) -> bytes:
    with filesystem.open_input_stream(path) as source:
        return source.read()


def move_file(filesystem: pafs.FileSystem, source: str, target: str, replace: bool = True) -> None:
    """Move a file, by copy and delete where a rename fails. Running it again changes nothing.

    A missing source with the target in place counts as done. With ``replace=False`` an existing
    target that holds other bytes is an error, so nothing is overwritten.
    """
    if not replace and exists(filesystem, target):
        if exists(filesystem, source):
            if not same_bytes(filesystem, source, target):
                raise FileExistsError(target)
            filesystem.delete_file(source)
        return
    try:
        _in_folder_of(filesystem, target, lambda: _replace(filesystem, source, target))
    except OSError as error:
        if exists(filesystem, source):
            write_file(filesystem, target, _blocks(filesystem, source))
            filesystem.delete_file(source)
        elif not exists(filesystem, target):
            raise FileNotFoundError(source) from error


def name_file(filesystem: pafs.FileSystem, source: str, target: str) -> None:
    """Give a staged file its name, as ``move_file`` does.

    On a local disk, if the name is free, it is a second one for a moment: renames between folders wait for each other there.
    """
    if filesystem.type_name == "local":
        try:
            try:
                os.link(source, target)
            except FileNotFoundError:
                os.makedirs(_parent(target), exist_ok=True)
                os.link(source, target)
            os.unlink(source)
            return
        except FileExistsError:
            # A rename of one name of a file to another does nothing, so a call that was broken off in between ends here.
            if os.path.samefile(source, target):
                os.unlink(source)
                return
        except OSError:
            pass  # the file has gone, or the disk has no second names
    move_file(filesystem, source, target)


def delete_file(filesystem: pafs.FileSystem, path: str) -> None:
    """Delete a file; an absent file counts as deleted."""
    if exists(filesystem, path):
        filesystem.delete_file(path)
