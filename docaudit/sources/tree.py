"""S8 as files: a sink that writes one file per document and replaces a whole tree at once."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _inside(path: str) -> str:
    """A relative path that stays below its root."""
    plain = posixpath.normpath(path)
    if not path or plain.startswith(("/", "../")) or plain in (".", ".."):
        raise ValueError(f"not a path below the tree: {path!r}")
    return plain


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    """Tasks write into a tree of their own; only when all have ended does it take the place of the old one.

    A file is written under another name first, so a task that is repeated, or runs twice at once, leaves the same files.
    """

    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite = target.rstrip("/"), overwrite
        self.fresh = f"{self.target}.new-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = _system(self.fresh)
        n = 0
        for row in rows:
            name = f"{root}/{_inside(row['path'])}"
            system.create_dir(posixpath.dirname(name), recursive=True)
            started = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(started) as out:
                out.write((row["text"] or "").encode())
            system.move(started, name)
            n += 1
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, fresh = _system(self.fresh)
        _, target = _system(self.target)
        system.create_dir(fresh, recursive=True)
        there = system.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            system.delete_dir(fresh)
            raise FileExistsError(self.target)
        if there:
            system.move(target, f"{fresh}.old")
        system.move(fresh, target)
        if there:
            system.delete_dir(f"{fresh}.old")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, fresh = _system(self.fresh)
        if system.get_file_info(fresh).type != fs.FileType.NotFound:
            system.delete_dir(fresh)


class TreeSink(DataSource):
    """Format ``document_tree``: rows (path, text) as files below the option ``path``, a folder that all machines share."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"], overwrite)


def write_tree(documents: DataFrame, target: str, path: str = "path", text: str = "text") -> None:
    """One file per document below ``target``, in the tree that the paths make; what was there before is replaced, or stays if a task fails.

    Paths are unique; one that leaves the tree fails the job.
    """
    documents.sparkSession.dataSource.register(TreeSink)
    documents.selectExpr(f"`{path}` AS path", f"`{text}` AS text").write.format("document_tree").mode("overwrite").save(target)
