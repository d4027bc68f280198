"""Files that tasks write themselves into the shared folder.

A task writes under a name that no other attempt has and reports it in a row; the rows are stored, and only files that
they name are ever read. So a task that is run again, or twice, leaves at most files that nobody looks at."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def new_file(folder: str, stem: str, suffix: str) -> tuple[str, fs.FileSystem, str]:
    """(URI, file system, path) of a file of its own in ``folder``, which is made."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system, f"{path}/{name}"
