"""Files that tasks write to and read from the shared folder, by URI."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain absolute path is local."""
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file under a name no other task or attempt uses; only rows returned by the task that finished name it."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, path = located(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out: pa.NativeFile = system.open_output_stream(path)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; returns where the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        return self.uri


class Readers:
    """Range reads with a few files kept open."""

    def __init__(self, limit: int = 32) -> None:
        self.open: OrderedDict[str, BinaryIO] = OrderedDict()
        self.limit = limit

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.limit:
                self.open.popitem(last=False)[1].close()
            system, path = located(uri)
            self.open[uri] = system.open_input_file(path)
        self.open.move_to_end(uri)
        return self.open[uri].read_at(length, offset)

    def close(self) -> None:
        for file in self.open.values():
            file.close()


def delete(uri: str) -> None:
    system, path = located(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)
