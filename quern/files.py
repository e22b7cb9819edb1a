"""Files that executors write to and read from the shared folder: local paths directly, others through pyarrow."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme == "file" else uri if not u.scheme else None


@contextmanager
def replacing(uri: str):
    """A binary file that appears under its name only when complete, so that a retried task does no harm."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                yield f
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)
        return
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(uri)
    part = f"{name}.{uuid.uuid4().hex}.part"
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part) as f:
        yield f
    fs.move(part, name)


@contextmanager
def reading(uri: str):
    """A seekable binary file."""
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            yield f
        return
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(uri)
    with fs.open_input_file(name) as f:
        yield f


def remove(uri: str) -> None:
    path = _local(uri)
    if path is not None:
        os.remove(path)
        return
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(uri)
    fs.delete_file(name)
