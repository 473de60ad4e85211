"""Files below the shared folder, read and written by tasks through any file system that pyarrow knows."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; the folder of a local one is made."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return system, path


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name of its own for each task attempt: a repeated task never touches what another has written."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{prefix}-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}{suffix}"


class RangeReader:
    """Ranges of files by path, one file open at a time."""

    def __init__(self, folder: str) -> None:
        self.system, self.folder = open_fs(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(os.path.join(self.folder, name))
        return self.file.read_at(length, offset)

    def size(self, name: str) -> int:
        return self.system.get_file_info(os.path.join(self.folder, name)).size

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
