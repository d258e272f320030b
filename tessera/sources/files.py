"""Opening of files by plain path or URI."""

from __future__ import annotations

from typing import BinaryIO

import pyarrow.fs


def _at(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def open_file(path: str) -> BinaryIO:
    fs, at = _at(path)
    return fs.open_input_file(at)


def exists(path: str) -> bool:
    fs, at = _at(path)
    return fs.get_file_info(at).type == pyarrow.fs.FileType.File
