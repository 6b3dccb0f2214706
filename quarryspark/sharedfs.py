"""Whole-file reads and writes in the shared folder, from Python workers.

Files are written under a temporary name and moved into place, so a task that is run
again (lost executor, speculation) replaces a file by the same bytes and readers never
see a half-written one.
"""

from __future__ import annotations

import functools
import uuid
from urllib.parse import urlparse


@functools.lru_cache(maxsize=8)
def _filesystem(scheme: str, authority: str):
    import pyarrow.fs as pf

    if scheme in ("", "file"):
        return pf.LocalFileSystem()
    return pf.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def _locate(uri: str):
    u = urlparse(uri)
    path = u.path if u.scheme in ("", "file") or u.scheme == "hdfs" else f"{u.netloc}{u.path}"
    return _filesystem(u.scheme, u.netloc), path


def put(uri: str, *parts: bytes) -> None:
    """Write ``parts`` one after another as the file ``uri``, atomically."""
    fs, path = _locate(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for p in parts:
            out.write(p)
    fs.move(temporary, path)


def get(uri: str) -> bytes:
    fs, path = _locate(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def open_random(uri: str):
    """A seekable reader, for formats that are read from their end."""
    fs, path = _locate(uri)
    return fs.open_input_file(path)
