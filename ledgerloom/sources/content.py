"""Files named by their content (SNK-14), as a sink of Spark: ``df.write.format("content_files").mode("append").option("path", root)``.

Rows are (name, content) or (folder, name, content). A file is ``<first 12 hex digits of its SHA-256>_<safe name>``, so a name never stands for two contents, and a task
that runs twice, or two writers at once, make the same file. Each task writes beside the target under a name of its own, and the rename is what
makes the file; one that is there is not written again. Abort removes what tasks have left unfinished. It leaves finished files: they are
whole, and another writer may have found them there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ledgerloom.functions.text import safe_filename

#: Hex digits of the digest in a name; the folder of unfinished files.
DIGITS = 12
UNFINISHED = "_unfinished"


@dataclass
class Saved(WriterCommitMessage):
    made: int
    there: int
    bytes: int


class ContentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("files named by their content are never overwritten: use mode('append')")
        self.root, self.job = options["path"], uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def write(self, iterator: Iterator[Row]) -> Saved:
        store, root = self._open()
        made = there = size = 0
        for row in iterator:
            folder = f"{root}/{row['folder']}" if "folder" in row and row["folder"] else root
            data = bytes(row["content"])
            target = f"{folder}/{hashlib.sha256(data).hexdigest()[:DIGITS]}_{row['name']}"
            if store.get_file_info(target).type != fs.FileType.NotFound:
                there += 1
                continue
            own = f"{root}/{UNFINISHED}/{self.job}/{uuid.uuid4().hex}"
            store.create_dir(own.rpartition("/")[0], recursive=True)
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, target)
            made, size = made + 1, size + len(data)
        return Saved(made, there, size)

    def _clear(self) -> None:
        store, root = self._open()
        if store.get_file_info(f"{root}/{UNFINISHED}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{UNFINISHED}/{self.job}")

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class ContentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "content_files"

    def writer(self, schema: StructType, overwrite: bool) -> ContentWriter:
        if not {"name", "content"} <= {*schema.names}:
            raise ValueError("rows need a name and a content")
        return ContentWriter(self.options, overwrite)


def saved_name(content: Column, name: Column) -> Column:
    """What a file is called: known without saving it."""
    return F.concat(F.substring(F.sha2(content, 256), 1, DIGITS), F.lit("_"), safe_filename(name))


def save_files(rows: DataFrame, root: str, content: str = "content", name: str = "name", folder: str | None = None) -> None:
    """SNK-14: the files of ``rows`` below ``root`` (in the folder that a column names); those without content are left out. Equal content under one name
    is sent once."""
    rows.sparkSession.dataSource.register(ContentFiles)
    own = rows.where(F.col(content).isNotNull()).select(*([safe_filename(F.col(folder)).alias("folder")] if folder else []), safe_filename(F.col(name)).alias("name"), F.col(content).cast("binary").alias("content"))
    keyed = own.withColumn("_digest", F.sha2("content", 256))
    once = keyed.groupBy(*[c for c in keyed.columns if c != "content"]).agg(F.any_value("content").alias("content")).drop("_digest")
    once.write.format("content_files").mode("append").option("path", root).save()
