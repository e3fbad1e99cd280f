"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space at the ends of words and lines: 0x20 and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; letters outside ASCII stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder serves a driver that runs all tasks itself."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... in their order, and the new name of each old one: no name of the user's can clash with one of ours.

    The result of what is then done goes back to the user's names with toDF(*docs.columns).
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle of rows that Python will work on."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup a partition sorted by `key` so that no key spans two tables.

    Groups must be of bounded size; only the last group of a batch is carried over.
    """
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*carried, batch.slice(0, cut)])
            carried = [batch.slice(cut)]
        elif carried and carried[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(carried)
            carried = [batch]
        else:
            carried.append(batch)
    if carried:
        yield pa.Table.from_batches(carried)


def lengths_to_list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def text_slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about so many bytes, with the row at which each begins; nulls become empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def distinct_words(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of the lists, the number of each word, and the distinct words in order of their numbers."""
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def ragged_take(flat: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array by number: their values end to end, and the length of each."""
    starts = np.cumsum(lengths) - lengths
    out = lengths[rows]
    shift = starts[rows] - (np.cumsum(out) - out)
    return flat[np.repeat(shift, out) + np.arange(int(out.sum()))], out


def sums_by_list(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each list; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
