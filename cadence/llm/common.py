"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAPS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """`body(v)` with v bound to `value`, which is then computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text: no words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def crc_mod(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def hashed_share(key: Column, share: float) -> Column:
    """Whether the 64-bit hash of a key is among the smallest `share` (0 to 1) of all hashes, however small the share."""
    return F.lit(True) if share >= 1 else F.xxhash64(key) < F.lit(int(share * 2.0**64) - 2**63)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_store(uri: str):
    """(filesystem, path) of a URI, on the driver or in a task."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Published:
    """A file that appears under its final name only when it is whole; a repeated task replaces it."""

    def __init__(self, uri: str):
        self.store, self.path = open_store(uri)
        self.tmp = posixpath.join(posixpath.dirname(self.path), f".tmp-{uuid.uuid4().hex}")
        self.store.create_dir(posixpath.dirname(self.path), recursive=True)
        self.out = self.store.open_output_stream(self.tmp)

    def write(self, data) -> None:
        self.out.write(data)

    def close(self) -> None:
        from pyarrow import fs

        self.out.close()
        if not isinstance(self.store, fs.LocalFileSystem) and self.store.get_file_info(self.path).type != fs.FileType.NotFound:
            self.store.delete_file(self.path)
        self.store.move(self.tmp, self.path)


class _Ranges:
    """Slices of a flat file in a store that can't be mapped; each is read as it is asked for."""

    def __init__(self, store, path: str, dtype):
        import numpy as np

        self.dtype = np.dtype(dtype)
        self.file = store.open_input_file(path)
        self.size = self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice):
        import numpy as np

        start, stop, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def mapped(uri: str, dtype):
    """A flat file as something to slice: memory-mapped where the store is a local or mounted folder, else read by range."""
    import numpy as np
    from pyarrow import fs

    store, path = open_store(uri)
    if not isinstance(store, fs.LocalFileSystem):
        return _Ranges(store, path, dtype)
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
