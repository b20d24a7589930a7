"""A CSV sink that appends in commits: what a job writes appears at once or not at all, and nothing twice.

Every task writes one file below ``_pending`` of the target: byte-order mark, header, all fields quoted. Its commit message
names the file. When all tasks are done the driver moves the named files into place; files of attempts that failed, ran
twice or were cut off are in no message and go with ``_pending``. Paths are opened by Arrow's file systems, so the target may
lie wherever Arrow can reach it, and must be shared by all executors.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BOM = "﻿"
FLUSH_ROWS = 1000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class AppendWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, path: str) -> None:
        self.names, self.path, self.job = schema.names, path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _opened(self.path)
        folder = f"{base}/_pending/{self.job}"
        name = f"part-{uuid.uuid4().hex}.csv"
        out, rows = None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:  # a task without rows leaves no file
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}")
                    out.write((BOM + self._lines([self.names])).encode())
                columns = [c.to_pylist() for c in batch.columns]
                for lo in range(0, batch.num_rows, FLUSH_ROWS):
                    part = zip(*(c[lo : lo + FLUSH_ROWS] for c in columns))
                    out.write(self._lines(part).encode())
                    out.flush()
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows)

    @staticmethod
    def _lines(rows) -> str:
        text = io.StringIO()
        csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(["" if v is None else v for v in row] for row in rows)
        return text.getvalue()

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.path)
        for m in messages:
            if m is not None and m.file:
                system.move(f"{base}/_pending/{self.job}/{m.file}", f"{base}/{m.file}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = _opened(self.path)
        folder = f"{base}/_pending/{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class AppendCsv(DataSource):
    """``df.write.format("append_csv").mode("append").save(path)``"""

    @classmethod
    def name(cls) -> str:
        return "append_csv"

    def writer(self, schema: StructType, overwrite: bool) -> AppendWriter:
        if overwrite:
            raise ValueError("this sink only appends")
        return AppendWriter(schema, self.options["path"])


def append_committed(df: DataFrame, path: str) -> None:
    """Append ``df`` to the CSV files in ``path``."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(AppendCsv)
    df.write.format("append_csv").mode("append").save(path)
