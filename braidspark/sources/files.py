"""Random access to files by local path, ``file:`` URI or any URI that pyarrow's filesystems know."""

from __future__ import annotations

import os
import re


def is_local(path: str) -> bool:
    return path.startswith("file:") or not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", path)


def local(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A seekable file for reading bytes."""
    if is_local(path):
        return open(local(path), "rb")
    system, name = _remote(path)
    return system.open_input_file(name)


def create_file(path: str):
    if is_local(path):
        os.makedirs(os.path.dirname(local(path)) or ".", exist_ok=True)
        return open(local(path), "wb")
    system, name = _remote(path)
    return system.open_output_stream(name)


def file_size(path: str) -> int:
    """Size in bytes of a file."""
    if is_local(path):
        return os.stat(local(path)).st_size
    system, name = _remote(path)
    return system.get_file_info(name).size


def exists(path: str) -> bool:
    if is_local(path):
        return os.path.exists(local(path))
    system, name = _remote(path)
    return system.get_file_info(name).type.name != "NotFound"


def is_folder(path: str) -> bool:
    if is_local(path):
        return os.path.isdir(local(path))
    system, name = _remote(path)
    return system.get_file_info(name).type.name == "Directory"


def names_in(folder: str) -> list[str]:
    """Names of the files of a folder, in order."""
    if is_local(folder):
        return sorted(x.name for x in os.scandir(local(folder)) if x.is_file())
    from pyarrow import fs

    system, name = _remote(folder)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(name)) if x.is_file)


def remove(path: str) -> None:
    if is_local(path):
        if os.path.isdir(local(path)):
            import shutil

            shutil.rmtree(local(path), ignore_errors=True)
        elif os.path.exists(local(path)):
            os.remove(local(path))
        return
    system, name = _remote(path)
    if system.get_file_info(name).type.name == "Directory":
        system.delete_dir(name)
    elif exists(path):
        system.delete_file(name)


def rename(old: str, new: str) -> None:
    if is_local(old):
        os.makedirs(os.path.dirname(local(new)) or ".", exist_ok=True)
        os.replace(local(old), local(new))
        return
    system, name = _remote(old)
    system.move(name, _remote(new)[1])
