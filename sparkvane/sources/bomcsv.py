"""CSV files with a byte-order mark, as spreadsheet programs expect them: a Spark data source to write to.

``df.write.format("bomcsv").mode("overwrite").save(folder)`` after ``register(spark)``. Each task writes a file of
a hidden name; the commit renames all of them, and with ``overwrite`` removes the older ones, so readers
never see a file of a failed task. Null is empty; fields are quoted where they need it.

The folder is any that pyarrow's file systems reach (a shared mount, ``file://``, ``hdfs://``); on a cluster all
executors must reach the same one.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BOM = b"\xef\xbb\xbf"
#: Characters of rows that a task holds before it writes them.
FLUSH_CHARS = 1 << 20


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written, and its rows."""

    file: str
    rows: int


class BomCsvWriter(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool) -> None:
        self.folder, self.names, self.overwrite = folder, schema.names, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Part:
        system, folder = _open(self.folder)
        system.create_dir(folder, recursive=True)
        name = f".{self.run}-{uuid.uuid4().hex}"
        rows = 0
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        try:
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(BOM)
                out.writerow(self.names)
                for row in iterator:
                    out.writerow(["" if v is None else v for v in row])
                    rows += 1
                    if text.tell() > FLUSH_CHARS:
                        f.write(text.getvalue().encode())
                        text.seek(0)
                        text.truncate()
                f.write(text.getvalue().encode())
        except BaseException:
            system.delete_file(f"{folder}/{name}")
            raise
        return Part(name, rows)

    def _files(self, prefix: str) -> list[str]:
        from pyarrow import fs

        system, folder = _open(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [x.path for x in found if x.is_file and x.base_name.startswith(prefix)]

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = _open(self.folder)
        old = self._files("part-") if self.overwrite else []
        done = {m.file for m in messages if m is not None}
        for i, name in enumerate(sorted(done)):
            system.move(f"{folder}/{name}", f"{folder}/part-{i:05d}-{self.run}.csv")
        for path in old + self._files(f".{self.run}"):  # older files, and those of attempts that did not count
            system.delete_file(path)

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = _open(self.folder)
        for path in self._files(f".{self.run}"):
            system.delete_file(path)


class BomCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bomcsv"

    def writer(self, schema: StructType, overwrite: bool) -> BomCsvWriter:
        return BomCsvWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BomCsv)
