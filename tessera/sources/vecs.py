"""Binary vector files as Spark data sources: ``xvecs`` (one header a record) and ``fbin``.

``spark.dataSource.register(XvecsSource)``, then ``spark.read.format("xvecs").load(path)``
gives ``vec_id, embedding``. A record of an xvecs file is an int32 length and as many
little-endian elements; the element type follows from the suffix or the ``dtype`` option.
An fbin file has the counts of rows and of components as int32, then float32 values.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

from . import files

#: Suffix to numpy type and Spark element type; fixed by the format.
ELEMENTS = {
    "fvecs": ("<f4", "float"),
    "ivecs": ("<i4", "int"),
    "bvecs": ("u1", "smallint"),
    "ui8vecs": ("u1", "smallint"),
    "ui16vecs": ("<u2", "int"),
    "uivecs": ("<u4", "bigint"),
    "ulvecs": ("<u8", "decimal(20,0)"),
}


@dataclass
class Range(InputPartition):
    first: int
    last: int


def _kind(options: dict) -> tuple[np.dtype, str]:
    name = options.get("dtype") or os.path.basename(options["path"]).rpartition(".")[2]
    if name not in ELEMENTS:
        raise ValueError(f"unknown element type {name!r}; one of {', '.join(ELEMENTS)}")
    return np.dtype(ELEMENTS[name][0]), ELEMENTS[name][1]


class _RangeReader(DataSourceReader):
    """Deals byte ranges of whole records to tasks."""

    def __init__(self, options: dict):
        self.options = options
        self.path = options["path"]
        self.dtype, self.element = self.kind()
        self.dim, self.rows, self.header, self.start = self.layout()
        limit = options.get("limit")
        if limit is not None:
            if int(limit) > self.rows:
                raise ValueError(f"{limit} rows asked for, {self.path} has {self.rows}")
            self.rows = int(limit)

    def partitions(self) -> list[Range]:
        per = max(1, int(self.options.get("partition_bytes", 64 << 20)) // max(1, self.record()))
        return [Range(a, min(a + per, self.rows)) for a in range(0, self.rows, per)] or [Range(0, 0)]

    def record(self) -> int:
        return self.header + self.dim * self.dtype.itemsize

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        size = self.record()
        step = max(1, (8 << 20) // max(1, size))
        with open(self.path, "rb") as f:
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                f.seek(self.start + a * size)
                raw = np.frombuffer(f.read(n * size), np.uint8).reshape(n, size)[:, self.header :]
                values = np.ascontiguousarray(raw).view(self.dtype)
                if self.element.startswith("decimal"):
                    flat = pa.array([Decimal(int(v)) for v in values.ravel()], pa.decimal128(20, 0))
                else:
                    flat = pa.array(values.ravel().astype({"float": "f4", "int": "i4", "smallint": "i2", "bigint": "i8"}[self.element]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.dim + 1, self.dim, dtype=np.int32)) if self.dim else pa.array([0] * (n + 1), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n, dtype=np.int64)), lists], ["vec_id", "embedding"])


class XvecsReader(_RangeReader):
    def kind(self):
        return _kind(self.options)

    def layout(self) -> tuple[int, int, int, int]:
        size = os.path.getsize(self.path)
        if size < 4:
            return 0, 0, 4, 0
        with open(self.path, "rb") as f:
            dim = int(np.frombuffer(f.read(4), "<i4")[0])
        if dim < 1:
            raise ValueError(f"{self.path}: length {dim} in the first record")
        return dim, size // (4 + dim * self.dtype.itemsize), 4, 0


class FbinReader(_RangeReader):
    def kind(self):
        return np.dtype("<f4"), "float"

    def layout(self) -> tuple[int, int, int, int]:
        with open(self.path, "rb") as f:
            rows, dim = (int(x) for x in np.frombuffer(f.read(8), "<i4"))
        whole = (os.path.getsize(self.path) - 8) // (4 * dim) if dim else 0
        return dim, min(rows, whole), 0, 8


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class XvecsWriter(DataSourceWriter):
    """Tasks write files of records; the commit joins them in order of their first id.

    Rows should be sorted by ``vec_id`` in ranges (``df.orderBy("vec_id")``).
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dtype, self.overwrite = options["path"], _kind(options)[0], overwrite

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        own = f"{self.path}.part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        n = 0
        with open(own, "wb") as f:
            for row in rows:
                values = np.array([int(v) for v in row["embedding"]], object) if self.dtype.kind in "iu" else np.array(row["embedding"])
                if self.dtype.kind in "iu" and len(values) and (values.min() < np.iinfo(self.dtype).min or values.max() > np.iinfo(self.dtype).max):
                    raise ValueError(f"row {row['vec_id']} doesn't fit {self.dtype}")
                f.write(np.array([len(values)], "<i4").tobytes() + values.astype(self.dtype).tobytes())
                n += 1
        return Part(own, n)

    def commit(self, messages: list[Part]) -> None:
        with open(self.path, "wb") as out:
            for part in sorted((m for m in messages if m), key=lambda m: m.path):
                with open(part.path, "rb") as f:
                    while block := f.read(8 << 20):
                        out.write(block)
                os.remove(part.path)

    def abort(self, messages: list[Part]) -> None:
        for part in messages:
            if part and os.path.exists(part.path):
                os.remove(part.path)


class XvecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xvecs"

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{_kind(self.options)[1]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return XvecsReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not isinstance(schema["embedding"].dataType, ArrayType):
            raise ValueError("embedding must be an array")
        return XvecsWriter(self.options, overwrite)


class FbinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FbinReader(self.options)


def register(spark) -> None:
    for source in (XvecsSource, FbinSource):
        spark.dataSource.register(source)


def read_vecs(spark, path: str, dtype: str | None = None, limit: int | None = None) -> DataFrame:
    """``vec_id, embedding`` of an xvecs file on any file system that Spark reaches, in splits of whole records.

    A partial record at the end is an error here; the ``xvecs`` source, for mounted paths, passes over it.
    """
    dtype, element = _kind({"path": path} | ({"dtype": dtype} if dtype else {}))
    length = files.size(spark, path)
    schema = f"vec_id bigint, embedding array<{element}>"
    if length < 4:
        return spark.createDataFrame([], schema)
    dim = int(np.frombuffer(files.head(spark, path, 4), "<i4")[0])
    if dim < 1:
        raise ValueError(f"{path}: length {dim} in the first record")
    record = 4 + dim * dtype.itemsize
    if length % record:
        raise ValueError(f"{path}: {length} bytes are no whole number of records of {record}")
    if limit is not None and limit > length // record:
        raise ValueError(f"{limit} rows asked for, {path} has {length // record}")
    records = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"fixedlengthinputformat.record.length": str(record)},
    )
    convert = Decimal if element.startswith("decimal") else (float if element == "float" else int)
    rows = records.map(lambda r: (r[0] // record, [convert(x) for x in np.frombuffer(bytes(r[1]), dtype, offset=4).tolist()]))
    if limit is not None:
        rows = rows.filter(lambda r: r[0] < limit)
    return spark.createDataFrame(rows, schema)


def records_of(vectors: Iterable, dtype: str) -> Iterator[bytes]:
    """Records of an xvecs file, some megabytes at a time; values that don't fit the type are errors."""
    kind = np.dtype(ELEMENTS[dtype][0])
    block = bytearray()
    for vector in vectors:
        values = np.array([int(v) for v in vector], object) if kind.kind in "iu" else np.asarray(vector, np.float64)
        if kind.kind in "iu" and len(values) and (values.min() < np.iinfo(kind).min or values.max() > np.iinfo(kind).max):
            raise ValueError(f"a value doesn't fit {kind}")
        block += np.array([len(values)], "<i4").tobytes() + values.astype(kind).tobytes()
        if len(block) >= 4 << 20:
            yield bytes(block)
            block.clear()
    yield bytes(block)


def write_vecs(df: DataFrame, path: str, dtype: str | None = None, overwrite: bool = False) -> None:
    """One xvecs file of ``vec_id, embedding`` in order of the id, on any file system that Spark reaches.

    The file is one stream, written as the sorted partitions arrive at the driver, which holds one of them at a time.
    """
    spark = df.sparkSession
    name = dtype or os.path.basename(path).rpartition(".")[2]
    _kind({"path": path, "dtype": name})
    rows = df.select("vec_id", "embedding").orderBy("vec_id").toLocalIterator()
    files.write(spark, path, records_of((r["embedding"] for r in rows), name), overwrite)


#: Spark's element for the types of HDF5 numbers; unsigned ones go to the next larger signed type.
HDF5_ELEMENTS = {"i1": "smallint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "f4": "float", "f8": "double"}


def _h5py(what: str):
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError(f"{what} HDF5 needs h5py, which isn't installed") from e
    return h5py


def read_hdf5(spark, path: str, dataset: str, rows_per_task: int = 65_536) -> DataFrame:
    """A two-dimensional HDF5 dataset on a mounted path as ``vec_id, embedding``; tasks read ranges of rows. Needs h5py."""
    with _h5py("reading").File(path, "r") as f:
        (rows, dim), dtype = f[dataset].shape, np.dtype(f[dataset].dtype)
    element = HDF5_ELEMENTS.get(f"{dtype.kind}{dtype.itemsize}")
    if element is None:
        raise ValueError(f"{path}: {dataset} holds {dtype}; one of {', '.join(HDF5_ELEMENTS)}")
    own = np.dtype({"smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}[element])
    step = max(1, (8 << 20) // max(1, dim * own.itemsize))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _h5py("reading").File(path, "r") as f:
            for task in (t for batch in batches for t in batch["id"].to_pylist()):
                end = min(rows, (task + 1) * rows_per_task)
                for a in range(task * rows_per_task, end, step):
                    values = np.asarray(f[dataset][a : min(a + step, end)]).astype(own)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * dim), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(values), dtype=np.int64)), lists], ["vec_id", "embedding"])

    tasks = -(-rows // rows_per_task)
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, f"vec_id bigint, embedding array<{element}>")


def write_hdf5(df: DataFrame, path: str, dataset: str, block: int = 65_536) -> None:
    """``vec_id, embedding`` in order of the id as a two-dimensional HDF5 dataset on a mounted path; the driver holds a block of rows. Needs h5py."""
    element = df.schema["embedding"].dataType.elementType.simpleString()
    kind = {e: k for k, e in HDF5_ELEMENTS.items() if k[0] != "u" and k != "i1"}.get(element)
    if kind is None:
        raise ValueError(f"elements of {element} aren't written")
    with _h5py("writing").File(path, "w") as f:
        first = df.select(F.size("embedding")).first()
        data = f.create_dataset(dataset, shape=(df.count(), first[0] if first else 0), dtype=kind)
        at, held = 0, []
        for row in df.select("vec_id", "embedding").orderBy("vec_id").toLocalIterator():
            held.append(row["embedding"])
            if len(held) == block:
                data[at : at + block] = np.array(held, kind)
                at, held = at + block, []
        if held:
            data[at : at + len(held)] = np.array(held, kind)
