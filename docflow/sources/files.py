"""A data source that writes each row as a file of its own name: ``df.write.format("named_files").mode(...).save(path)``.

Rows are ``(name, value)``.  A task writes its files into a folder of its attempt below ``path/_staging``; when all tasks have ended, the job moves
one folder for each task to ``path/<job>-<task>``, lists these folders and how many files are in each in ``path/<job>.folders``, and writes
``_SUCCESS``.  What failed, retried or speculative attempts wrote goes with the staging folder.  There is no folder for each document, and the
driver learns one path for each task, also when ``read_back`` reads what was written.  Mode ``overwrite`` removes what
earlier jobs have written, ``append`` adds to it.

Paths are those that ``pyarrow.fs`` opens; a path without a scheme is local, and on a cluster has to be shared.  Options: ``suffix`` is put
behind every name.  Characters that no file name may hold become ``_``; of equal names in a task the second gets `` (2)``, and so on.  Rows
with a null name are an error, a null value is an empty file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"\w+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    task: int
    folder: str
    files: int


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["name", "value"]:
            raise ValueError(f"named_files takes columns name and value, not {schema.fieldNames()}")
        return NamedFilesWriter(self.options["path"].rstrip("/"), self.options.get("suffix", ""), overwrite)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        system, root = opened(self.path)
        folder = f"_staging/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(f"{root}/{folder}")
        taken: dict[str, int] = {}
        for row in iterator:
            if row["name"] is None:
                raise ValueError("a row without a name")
            name = re.sub(r"[/\\\x00-\x1F]", "_", row["name"])
            taken[name] = taken.get(name, 0) + 1
            name += f" ({taken[name]})" if taken[name] > 1 else ""
            with system.open_output_stream(f"{root}/{folder}/{name}{self.suffix}") as out:
                out.write((row["value"] or "").encode("utf-8", "surrogatepass"))
        return Written(context.partitionId(), folder, sum(taken.values()))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(f"{root}/_staging/{self.job}")  # no task may have written
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name != "_staging"] if self.overwrite else []
        for path in old:
            system.delete_dir(path) if system.get_file_info(path).type == fs.FileType.Directory else system.delete_file(path)
        for m in messages:
            if m is not None and m.files:
                system.move(f"{root}/{m.folder}", f"{root}/{self.job}-{m.task:05d}")
        system.delete_dir(f"{root}/_staging/{self.job}")
        with system.open_output_stream(f"{root}/{self.job}.folders") as out:
            for m in messages:
                if m is not None and m.files:
                    out.write((json.dumps({"folder": f"{self.job}-{m.task:05d}", "files": m.files}) + "\n").encode())
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/_staging/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staging/{self.job}")


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NamedFiles)
    return spark


# Files that a task reads at least, files and bytes of a batch.
_SHARE, _FILES, _BYTES = 2048, 512, 8 << 20


def read_back(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(name, value)`` of every file that jobs have written below ``path``, empty ones too; ``suffix`` keeps the files that end in it.

    A row for each share of a folder's files goes to a task of its own, which lists the folder and reads its share; Spark's own file sources list
    every file in the driver, pay for a small file as for 4 MB, and leave empty files out.
    """
    folders = spark.read.schema("folder string, files long").json(f"{path.rstrip('/')}/*.folders")
    shares = folders.select("folder", F.explode(F.sequence(F.lit(0), F.expr(f"(files - 1) div {_SHARE}"))).alias("share"))

    def run(batches):
        system, root = opened(path.rstrip("/"))
        names, values, size = [], [], 0
        for b in batches:
            for folder, share in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                every = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/{folder}")))
                for name in every[share * _SHARE : (share + 1) * _SHARE]:
                    if not name.endswith(suffix):
                        continue
                    with system.open_input_stream(f"{root}/{folder}/{name}") as held:
                        values.append(held.read())
                    names.append(name)
                    size += len(values[-1])
                    if len(names) == _FILES or size > _BYTES:
                        yield _rows(names, values)
                        names, values, size = [], [], 0
        yield _rows(names, values)

    return shares.repartition(max(1, shares.count())).mapInArrow(run, "name string, value string")


def _rows(names: list[str], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary()).cast(pa.string())], names=["name", "value"])
