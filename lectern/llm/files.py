"""Files in the shared folder, written by tasks and read by others: as a whole, by byte range, or mapped into memory."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

import numpy as np


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def new_name(folder: str, stem: str, suffix: str) -> str:
    """A name that no other attempt of the task uses; what a lost attempt leaves is never referred to."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def writer(uri: str):
    system, path = _open(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)  # else the name decides


def write(uri: str, data: bytes) -> None:
    with writer(uri) as out:
        out.write(data)


@functools.lru_cache(maxsize=64)
def reader(uri: str):
    system, path = _open(uri)
    return system.open_input_file(path)


@functools.lru_cache(maxsize=4096)
def mapped(uri: str) -> np.ndarray:
    """The file's bytes, mapped. A file in a remote store is first copied to a nameless local file."""
    if uri.startswith("file:") or "://" not in uri:
        path = uri[len("file://") :] if uri.startswith("file://") else uri.removeprefix("file:")
        return np.asarray(np.memmap(path, np.uint8, "r"))
    with tempfile.TemporaryFile() as copy:
        source = reader(uri)
        at, size = 0, source.size()
        while at < size:
            at += copy.write(source.read_at(min(8 << 20, size - at), at))
        copy.flush()
        return np.asarray(np.memmap(copy, np.uint8, "r"))
