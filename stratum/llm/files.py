"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's URI, the folder made if it was missing."""
    system, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(path, recursive=True)
    return system, path


def new_name(kind: str, ending: str) -> str:
    """A name that no other attempt of a task uses: only files that a committed row names count."""
    return f"{kind}-{uuid.uuid4().hex}{ending}"
