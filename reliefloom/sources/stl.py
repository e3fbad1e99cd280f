"""Binary STL: models as 50-byte records, and the triangle count read back from a file."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.blocks import cornered
from ..operators.runs import RUN, in_runs

HEADER_BYTES = 80
RECORD = np.dtype([("f", "<f4", 12), ("end", "<u2")])


def file_name(slug: Column, width_mm: Column, day: Column) -> Column:
    """relief_{slug}_{size}mm_{yyyymmdd}.stl; whole sizes without decimals, others with one."""
    size = F.when(width_mm == F.floor(width_mm), F.floor(width_mm).cast("string")).otherwise(F.format_string("%.1f", width_mm))
    return F.concat(F.lit("relief_"), slug, F.lit("_"), size, F.lit("mm_"), F.date_format(day, "yyyyMMdd"), F.lit(".stl"))


def slug(name: Column) -> Column:
    """Lower case, other characters as dashes, at most 40 characters, `model` if nothing is left."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 40)
    return F.when(F.coalesce(s, F.lit("")) == "", "model").otherwise(s)


def facets(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """model_id, tid, record: one 50-byte record for each triangle, with its face normal; of a number that several vertices have, one is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.stack([b.column(f"{v}{k}").to_numpy() for v in "abc" for k in "xyz"], axis=1).reshape(-1, 3, 3)
            n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
            length = np.sqrt((n * n).sum(axis=1, keepdims=True))
            n = np.divide(n, length, out=np.zeros_like(n), where=length > 0)
            rec = np.zeros(len(p), RECORD)
            rec["f"] = np.concatenate([n[:, None], p], axis=1).reshape(-1, 12)
            raw = rec.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("model_id"), b.column("tid"), pa.array([raw[i : i + 50] for i in range(0, len(raw), 50)], pa.binary())], names=["model_id", "tid", "record"])

    c = cornered(triangles, vertices)
    kind = dict(c.dtypes)["model_id"]
    return c.select("model_id", "tid", *(f"{v}{k}" for v in "abc" for k in "xyz")).mapInArrow(run, f"model_id {kind}, tid long, record binary")


def placed(records: DataFrame, per_run: int = RUN) -> DataFrame:
    """records with `_i`, their place in their model's file in the order of tid, `_run`, and `n`, the number of its records."""
    runs = in_runs(records, ["model_id"], "tid", per_run)
    return runs.join(runs.groupBy("model_id").agg(F.count("*").alias("n")), "model_id")


def chunks(records: DataFrame, header: str, per_chunk: int = RUN) -> DataFrame:
    """model_id, chunk, bytes: file content in order, of bounded rows; chunk 0 begins with header and count, whatever the numbers of the triangles are."""
    body = placed(records, per_chunk).groupBy("model_id", F.col("_run").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_i", "record"))).alias("r"), F.first("n").alias("n"))
    count = F.to_binary(F.concat(*(F.lpad(F.hex(F.shiftright("n", 8 * k).bitwiseAND(255)), 2, "0") for k in range(4))), F.lit("hex"))
    head = F.concat(F.lit(head_text(header)), count)
    data = F.to_binary(F.array_join(F.transform("r", lambda x: F.hex(x["record"])), ""), F.lit("hex"))
    return body.select("model_id", "chunk", F.when(F.col("chunk") == 0, F.concat(head, data)).otherwise(data).alias("bytes"))


def head_text(header: str) -> bytes:
    return header.encode("ascii", "replace")[:HEADER_BYTES].ljust(HEADER_BYTES, b"\0")


def write_files(triangles: DataFrame, vertices: DataFrame, names: DataFrame, folder: str, header: str) -> None:
    """A binary STL file in `folder` for each model of names (model_id, file); models without triangles give none.

    Any number of tasks write a file together: each record has its place, so a task puts its runs where they belong, and one
    that is run again writes the same bytes to the same places. When all have ended, each file gets its head and its name.
    Numbered records are in their order already, and are written by the tasks that read them.
    """
    spark = triangles.sparkSession
    spark.dataSource.register(StlFiles)
    rows = placed(facets(triangles, vertices)).join(names.select("model_id", "file"), "model_id").select("file", "n", "_i", "record")
    rows.sortWithinPartitions("file", "_i").write.format(StlFiles.name()).mode("append").option("folder", folder).option("header", header).save()


class StlFiles(DataSource):
    """Sink of rows `file, n, _i, record` for a folder on a file system that driver and executors have mounted."""

    @classmethod
    def name(cls) -> str:
        return "stl_files"

    def schema(self) -> str:
        return "file string, n long, _i long, record binary"

    def writer(self, schema: StructType, overwrite: bool) -> StlWriter:
        return StlWriter(self.options["folder"], self.options["header"])


@dataclass
class Written(WriterCommitMessage):
    """For each file, how many records a task wrote, and how many there are."""

    files: dict[str, tuple[int, int]]


class StlWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, header: str):
        if "://" in folder and not folder.startswith("file://"):
            raise ValueError(f"{folder}: records are put in their places, which takes a mounted file system")
        self.folder, self.header, self.job = re.sub("^file:(//)?", "", folder), header, uuid.uuid4().hex

    def _unfinished(self, file: str) -> str:
        return os.path.join(self.folder, f".{file}.{self.job}")

    def _opened(self, file: str) -> int:
        return os.open(self._unfinished(file), os.O_RDWR | os.O_CREAT, 0o644)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        done: dict[str, tuple[int, int]] = {}
        for b in iterator:
            if not b.num_rows:
                continue
            files, places, n = b.column(0).to_pylist(), b.column(2).to_numpy(), b.column(1).to_pylist()
            records = b.column(3).to_pylist()
            new = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or places[i] != places[i - 1] + 1), len(files)]
            for first, last in zip(new, new[1:]):
                at = self._opened(files[first])
                try:
                    os.pwrite(at, b"".join(records[first:last]), HEADER_BYTES + 4 + RECORD.itemsize * int(places[first]))
                finally:
                    os.close(at)
                done[files[first]] = (done.get(files[first], (0, 0))[0] + last - first, n[first])
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        wrote: dict[str, int] = {}
        due: dict[str, int] = {}
        for m in messages:
            for file, (k, n) in (m.files if m else {}).items():
                wrote[file], due[file] = wrote.get(file, 0) + k, n
        if wrote != due:
            raise ValueError(f"records are missing: {[f for f in due if wrote[f] != due[f]]}")
        for file, n in due.items():
            at = self._opened(file)
            os.pwrite(at, head_text(self.header) + n.to_bytes(4, "little"), 0)
            os.fsync(at)
            os.close(at)
            os.replace(self._unfinished(file), os.path.join(self.folder, file))

    def abort(self, messages: list[Written | None]) -> None:
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if name.endswith(self.job):
                os.remove(os.path.join(self.folder, name))


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, bytes of the files in a mounted folder: `bytes` are the head with its count, and nothing after it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                with open(unquote(re.sub("^file:/+", "/", path)), "rb") as f:
                    found.append(f.read(HEADER_BYTES + 4))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(found, pa.binary())], names=["path", "length", "bytes"])

    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.mapInArrow(run, "path string, length long, bytes binary")


def triangle_count(content: Column) -> Column:
    """The count in a file's bytes 80 to 83, little endian."""
    byte = lambda k: F.conv(F.hex(F.substring(content, HEADER_BYTES + 1 + k, 1)), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
