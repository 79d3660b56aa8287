"""Binary CSR matrices as a Spark data source (``spark.read.format("csr")``) and sink.

Layout, little-endian: nrow, ncol, nnz as int64; indptr int64[nrow + 1]; indices
int32[nnz]; data float32[nnz].  Paths must be readable as files by the driver and
all executors (a shared mount on a cluster).
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.quantize import positive
from ..schema import CSR

HEADER = struct.Struct("<qqq")
#: Rows of one record batch.
BATCH_ROWS = 10_000


def read_header(path: str) -> tuple[int, int, int]:
    """nrow, ncol, nnz; the file must be exactly as long as they say."""
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
    if len(head) < HEADER.size:
        raise ValueError(f"{path}: no CSR header")
    nrow, ncol, nnz = HEADER.unpack(head)
    if min(nrow, ncol, nnz) < 0 or os.path.getsize(path) != HEADER.size + 8 * (nrow + 1) + 8 * nnz:
        raise ValueError(f"{path}: size does not match its header")
    return nrow, ncol, nnz


class _Rows(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class CsrReader(DataSourceReader):
    """Row ranges of about equal numbers of elements; each task seeks to its own."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.per_task = int(options.get("elements_per_partition", 4_000_000))
        self.limit = int(options.get("limit_rows", -1))

    def partitions(self):
        nrow, ncol, nnz = read_header(self.path)
        indptr = np.memmap(self.path, "<i8", "r", HEADER.size, (nrow + 1,))
        if indptr[0] != 0 or indptr[-1] != nnz:
            raise ValueError(f"{self.path}: indptr does not match nnz")
        rows = nrow if self.limit < 0 else min(nrow, self.limit)
        parts, first = [], 0
        while first < rows:
            end = int(np.searchsorted(indptr, indptr[first] + self.per_task, "right")) - 1
            end = min(rows, max(first + 1, end))
            parts.append(_Rows(first, end))
            first = end
        return parts or [_Rows(0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        nrow, ncol, nnz = read_header(self.path)
        with open(self.path, "rb") as f:
            f.seek(HEADER.size + 8 * part.first)
            indptr = np.fromfile(f, "<i8", part.end - part.first + 1)
            if len(indptr) < 2:
                return
            n = int(indptr[-1] - indptr[0])
            f.seek(HEADER.size + 8 * (nrow + 1) + 4 * int(indptr[0]))
            indices = np.fromfile(f, "<i4", n)
            f.seek(HEADER.size + 8 * (nrow + 1) + 4 * nnz + 4 * int(indptr[0]))
            data = np.fromfile(f, "<f4", n)
        if n and (indices.min() < 0 or indices.max() >= ncol):
            raise ValueError(f"{self.path}: column index out of range")
        at = indptr - indptr[0]
        if (np.diff(at) < 0).any():
            raise ValueError(f"{self.path}: indptr falls")
        rows = len(at) - 1
        for a in range(0, rows, BATCH_ROWS):
            b = min(a + BATCH_ROWS, rows)
            bounds, own = pa.array((at[a : b + 1] - at[a]).astype(np.int32)), slice(int(at[a]), int(at[b]))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[own])) for x in (indices, data)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + a, part.first + b)), *lists], ["row_id", "indices", "weights"])


class _Wrote(WriterCommitMessage):
    def __init__(self, part: str | None):
        self.part = part


class CsrWriter(DataSourceWriter):
    """Tasks write sorted parts beside the target; commit merges them with bounded buffers.

    Rows must come with row_id dense from 0 and ranges in order of partition
    (repartitionByRange + sort), as write_csr() deals them.
    """

    def __init__(self, options: dict):
        self.path, self.ncol = options["path"].removeprefix("file://"), int(options.get("ncol", 0))

    def write(self, rows):
        stem, first, n, lengths = None, None, 0, []
        for row in rows:
            if stem is None:
                first = row.row_id
                stem = f"{self.path}.part-{first:020d}-{uuid.uuid4().hex}"  # of its own for every attempt
                fi, fd = open(f"{stem}.i", "wb"), open(f"{stem}.d", "wb")
            np.asarray(row.indices or [], "<i4").tofile(fi)
            np.asarray(row.weights or [], "<f4").tofile(fd)
            lengths.append(len(row.indices or []))
        if stem is None:
            return _Wrote(None)
        fi.close(), fd.close()
        np.asarray(lengths, "<i8").tofile(f"{stem}.n")
        return _Wrote(stem)

    def commit(self, messages):
        stems = sorted(m.part for m in messages if m and m.part)
        lengths = [np.fromfile(f"{s}.n", "<i8") for s in stems]
        indptr = np.concatenate([[0], np.cumsum(np.concatenate([*lengths, np.zeros(0, "<i8")]))]).astype("<i8")
        ncol = self.ncol
        if not ncol:
            ncol = 1 + max([-1, *(int(np.fromfile(f"{s}.i", "<i4").max(initial=-1)) for s in stems)])
        with open(self.path, "wb") as out:
            out.write(HEADER.pack(len(indptr) - 1, ncol, int(indptr[-1])))
            indptr.tofile(out)
            for kind in "id":
                for s in stems:
                    with open(f"{s}.{kind}", "rb") as f:
                        while chunk := f.read(8 << 20):
                            out.write(chunk)
        self._clear(stems)

    def abort(self, messages):
        self._clear([m.part for m in messages if m and m.part])

    def _clear(self, stems):
        for s in stems:
            for kind in "ndi":
                if os.path.exists(f"{s}.{kind}"):
                    os.remove(f"{s}.{kind}")


class CsrDataSource(DataSource):
    """Options: path, elements_per_partition, limit_rows (reading); path, ncol (writing)."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return CSR

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        return CsrWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CsrDataSource)


def read_csr(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("csr").options(path=path, **options).load()


def write_csr(rows: DataFrame, path: str, ncol: int | None = None) -> None:
    """Write (row_id dense from 0, indices, weights) to one CSR file."""
    register(rows.sparkSession)
    dealt = rows.select("row_id", "indices", "weights").repartitionByRange("row_id").sortWithinPartitions("row_id")
    dealt.write.format("csr").options(path=path, ncol=ncol or 0).mode("append").save()


def csr_to_vectors(rows: DataFrame, out_id: str = "doc_id", quantized: bool = True) -> DataFrame:
    """Long form; weights quantized, zeros kept."""
    e = rows.select(F.col("row_id").alias(out_id), F.explode(F.arrays_zip("indices", "weights")).alias("e"))
    w = positive(F.col("e.weights")) if quantized else F.col("e.weights")
    return e.select(out_id, F.col("e.indices").alias("term"), w.alias("weight"))


def triplet_to_vectors(spark: SparkSession, indptr, indices, data, out_id: str = "query_id", quantized: bool = True) -> DataFrame:
    """An in-memory query batch given as CSR arrays."""
    rows = [(i, [int(x) for x in indices[a:b]], [float(x) for x in data[a:b]]) for i, (a, b) in enumerate(zip(indptr[:-1], indptr[1:]))]
    return csr_to_vectors(spark.createDataFrame(rows, CSR), out_id, quantized)
