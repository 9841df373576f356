"""A sink of parallel text files: a task writes all columns of its rows, and a commit shows the parts of all columns together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from codeloom.session import place


@dataclass
class Part(WriterCommitMessage):
    """The file name of a task's part, the same in every column's folder; None if it had no rows."""

    name: str | None


class AlignedWriter(DataSourceArrowWriter):
    """Parts are written under hidden names, so those of lost or repeated tasks are never read, and get their names when
    all tasks are done."""

    def __init__(self, uri: str, columns: list[str]) -> None:
        self.uri, self.columns = uri, columns

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        files, path = place(self.uri)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.txt"
        outs = []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not outs:
                    outs = [files.open_output_stream(f"{path}/{c}/.{name}", compression=None) for c in self.columns]
                for out, column in zip(outs, batch.columns):
                    out.write("".join(f"{v or ''}\n" for v in column.to_pylist()).encode())
        finally:
            for out in outs:
                out.close()
        return Part(name if outs else None)

    def commit(self, messages: list[Part | None]) -> None:
        files, path = place(self.uri)
        for column in self.columns:
            for message in messages:
                if message is not None and message.name is not None:
                    files.move(f"{path}/{column}/.{message.name}", f"{path}/{column}/{message.name}")
            self._sweep(files, f"{path}/{column}")
            with files.open_output_stream(f"{path}/{column}/_SUCCESS", compression=None):
                pass

    def abort(self, messages: list[Part | None]) -> None:
        files, path = place(self.uri)
        for column in self.columns:
            self._sweep(files, f"{path}/{column}")

    @staticmethod
    def _sweep(files: fs.FileSystem, folder: str) -> None:
        """Remove hidden parts that no committed task stands for."""
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith(".part-"):
                files.delete_file(info.path)


class AlignedText(DataSource):
    """Format ``aligned_text``: one folder of text parts per string column below ``path``, in append mode to a new path."""

    @classmethod
    def name(cls) -> str:
        return "aligned_text"

    def writer(self, schema, overwrite: bool) -> AlignedWriter:
        return AlignedWriter(self.options["path"], schema.names)


def write_aligned(df, path: str) -> None:
    """Write the string columns of ``df`` to ``path/<column>``, in the order of its rows; nulls are empty lines.

    Line n of each folder belongs to one row, whatever tasks were lost or repeated. The path must be new.
    """
    files, at = place(path)
    if files.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    for column in df.columns:
        files.create_dir(f"{at}/{column}", recursive=True)
    df.sparkSession.dataSource.register(AlignedText)
    df.write.format("aligned_text").mode("append").save(path)
