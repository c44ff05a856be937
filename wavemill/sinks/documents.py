"""One JSON document of many rows, in order (survey K02, K03, K05, U07): a Spark data source writer with commit messages.

Each task writes its rows as a part, beside the document. The commit joins the parts in the order of the
tasks' numbers, through a buffer of fixed size, and shows the result by one rename. So readers see the old
document or the new one; a failed job takes its parts away, and parts of failed attempts are in no message.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources import files

COPY_BYTES = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    rank: int
    path: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.field, self.head = options["path"], options.get("field", "detailed_results"), options.get("head", "{}")
        self.run, self.overwrite = uuid.uuid4().hex, overwrite
        store, at = files.opened(self.path)
        if not overwrite and store.get_file_info([at])[0].type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there; write with mode overwrite")
        if not isinstance(json.loads(self.head), dict) or self.field in json.loads(self.head):
            raise ValueError("head is a JSON object without the field of the rows")

    @property
    def parts(self) -> str:
        return f"{files.opened(self.path)[1]}.parts-{self.run}"

    def write(self, iterator: Iterator[Row]) -> Part:
        store, _ = files.opened(self.path)
        context = TaskContext.get()
        store.create_dir(self.parts, recursive=True)
        part, rows = f"{self.parts}/{context.partitionId():08d}-{context.taskAttemptId()}", 0
        with store.open_output_stream(part) as out:
            for row in iterator:
                out.write((",\n" if rows else "").encode() + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode())
                rows += 1
        return Part(context.partitionId(), part, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, path = files.opened(self.path)
        head = json.dumps(json.loads(self.head), ensure_ascii=False)[:-1]
        new = f"{path}.new-{self.run}"
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(new) as out:
            out.write(f"{head}{', ' if len(head) > 1 else ''}{json.dumps(self.field)}: [\n".encode())
            begun = False
            for part in sorted((m for m in messages if m and m.rows), key=lambda m: m.rank):
                if begun:
                    out.write(b",\n")
                with store.open_input_stream(part.path) as rows:
                    while data := rows.read(COPY_BYTES):
                        out.write(data)
                begun = True
            out.write(b"\n]}\n")
        store.move(new, path)
        self._clear(store)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(files.opened(self.path)[0])

    def _clear(self, store: fs.FileSystem) -> None:
        if store.get_file_info([self.parts])[0].type != fs.FileType.NotFound:
            store.delete_dir(self.parts)


class DocumentSink(DataSource):
    """df.write.format("json_document").mode("overwrite").options(field=..., head=...).save(file)"""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def write_document(results: DataFrame, path: str, summary: DataFrame | None = None, field: str = "detailed_results", overwrite: bool = True) -> None:
    """One document with the fields of `summary` (its first row) and the rows of `results`, in order of their partitions."""
    results.sparkSession.dataSource.register(DocumentSink)
    row = summary.first() if summary is not None else None
    head = json.dumps(row.asDict(recursive=True) if row else {}, default=str)
    results.write.format("json_document").mode("overwrite" if overwrite else "append").options(field=field, head=head).save(path)
