"""A sink that writes one text file a row, all or nothing.

Tasks write to a staging folder beside the target, each attempt to a folder of its own. Committing keeps the folders of the
attempts that succeeded and moves the staging folder to the target in one step; aborting deletes it. So an interrupted or
failed job leaves the target as it was, and readers never see a part of it.
"""

from __future__ import annotations

import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class TextFiles(DataSource):
    """format("text_files"): options path, key (column that names the file), text, suffix (.md)."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return _Writer(o["path"].rstrip("/"), o.get("key", "file_id"), o.get("text", "markdown"), o.get("suffix", ".md"), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, key: str, text: str, suffix: str, overwrite: bool) -> None:
        self.path, self.key, self.text, self.suffix, self.overwrite = path, key, text, suffix, overwrite
        self.staging = f"{path}-staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, root = _files(self.staging)
        folder, n = uuid.uuid4().hex, 0
        seen: set[str] = set()
        for row in rows:
            if row[self.key] is None:
                raise ValueError(f"a row without {self.key} has no file")
            name = urllib.parse.quote(str(row[self.key]), safe=" ,()") + self.suffix
            if name in seen:
                raise ValueError(f"{name} is written twice")
            seen.add(name)
            if not n:
                files.create_dir(f"{root}/{folder}", recursive=True)
            with files.open_output_stream(f"{root}/{folder}/{name}") as out:
                out.write((row[self.text] or "").encode())
            n += 1
        return _Written(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.staging)
        _, target = _files(self.path)
        kept = {m.folder for m in messages if m is not None and m.files}
        files.create_dir(root, recursive=True)
        for found in files.get_file_info(fs.FileSelector(root)):
            if found.base_name not in kept:  # of attempts that failed or were repeated
                files.delete_dir(found.path)
        there = files.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        old = f"{target}-old-{uuid.uuid4().hex}"
        if there:
            files.move(target, old)
        files.move(root, target)
        if there:
            files.delete_dir(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.staging)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)
