"""Files of a format of their own in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class TaskFile:
    """A file that appears under its name only when it is whole.

    Every attempt of a task writes to a name of its own and renames it at the
    end, so a repeated or speculative attempt replaces an equal file.
    """

    def __init__(self, folder: str, name: str):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path, recursive=True)
        self.path = f"{path}/{name}"
        self.part = f"{path}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.path


def write_whole(folder: str, name: str, data: bytes) -> str:
    file = TaskFile(folder, name)
    file.write(data)
    return file.commit()


def read_whole(folder: str, name: str) -> bytes:
    fs, path = open_folder(folder)
    with fs.open_input_stream(f"{path}/{name}") as source:
        return source.read()
