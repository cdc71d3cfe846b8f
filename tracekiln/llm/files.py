"""Binary files in shared storage, written and read inside tasks.

Any scheme that ``pyarrow.fs`` knows (``file``, ``hdfs``, ``s3``, ``gs``).  A
file appears under its final name only when complete: a task writes to a name
of its own and moves it, so a retried or speculative attempt replaces a whole
file by an equal one.
"""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def filesystem(uri: str):
    """(file system, path) of a URI or absolute path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """Output stream whose file gets its name when the block ends well."""
    fs, path = filesystem(uri)
    parent, name = posixpath.split(path)
    fs.create_dir(parent, recursive=True)
    temp = f"{parent}/.{name}.{uuid.uuid4().hex}"
    out = fs.open_output_stream(temp)
    try:
        yield out
    except BaseException:
        out.close()
        fs.delete_file(temp)
        raise
    out.close()
    fs.move(temp, path)


def opened(uri: str):
    """Random-access input file."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def streamed(uri: str):
    """Input stream (sequential reads)."""
    fs, path = filesystem(uri)
    return fs.open_input_stream(path, compression=None)
