"""Files of any store that Python's Arrow reaches, for data sources that write and read them in tasks."""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import quote

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (also in the form file:/folder), and the path in it."""
    found = re.match(r"file:/*(?=/)", path)
    if found:
        return fs.LocalFileSystem(), path[found.end() :]
    if re.match(r"[a-z][a-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def file_name(key: object) -> str:
    """A name that any store takes for a key, different for different keys."""
    plain = "_" if key is None else quote(str(key), safe="").replace(".", "%2E")
    return plain if len(plain) <= 120 else f"{plain[:60]}-{hashlib.sha256(plain.encode()).hexdigest()}"


def put_whole(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a file beside its place and move it there: whoever reads sees all of it or none, and of two writers one is left."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, path)


def is_file(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == fs.FileType.File
