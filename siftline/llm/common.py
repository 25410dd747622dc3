"""What the operators share: reading, bounded Arrow batches, hashes, shared folders."""

from __future__ import annotations

import ctypes
import json
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.shared import shared_folder, written  # noqa: F401  written: for the operators

#: Bytes of text that one step of a Python operator holds at a time.
SLICE_BYTES = 4 << 20
#: Distinct words that a worker's cache holds before it starts anew, and the bytes of the longest that it keeps.
CACHE_ENTRIES, CACHED_BYTES = 150_000, 64


#: Bytes of a table, as its files are, up to which its rows may be dealt out anew.
DEALT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one that comes in fewer splits than there are cores is dealt out first, a larger one never."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= DEALT_BYTES
    return df.repartition(cores) if small and df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches to `rows` rows and 16 MB, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


class Scratch:
    """Tables in the shared folder that are needed for a while."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, keep: int = 0) -> None:
        """Deletes all but the `keep` tables written last."""
        end = len(self.paths) - keep
        for path in self.paths[:end]:
            discard(self.spark, path)
        del self.paths[:end]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Store:
    """Arrays as files in a folder of any file system that pyarrow reaches. A task that runs again writes the same again."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def put(self, name: str, a: np.ndarray) -> None:
        self.fs.create_dir(self.path, recursive=True)
        temp = f"{self.path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
        with self.fs.open_output_stream(temp) as f:
            np.lib.format.write_array(_Writer(f), np.ascontiguousarray(a))
        self.fs.move(temp, f"{self.path}/{name}.npy")

    def get(self, name: str) -> np.ndarray:
        """Mapped into memory; from a folder that isn't on a mounted disk, the worker maps a copy that has no name."""
        path = f"{self.path}/{name}.npy"
        return np.load(path, mmap_mode="r") if isinstance(self.fs, pyarrow.fs.LocalFileSystem) else _copied(self.uri, name)

    def put_all(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Several arrays as one file: what they are in front, each from a multiple of 64 bytes on."""
        arrays = {k: np.ascontiguousarray(a) for k, a in arrays.items()}
        head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
        blocks = [np.frombuffer(b, np.uint8) for b in (len(head).to_bytes(8, "little"), head, *(a.tobytes() for a in arrays.values()))]
        sizes = [-(-len(b) // 64) * 64 for b in blocks]
        whole = np.zeros(sum(sizes), np.uint8)
        for b, end, n in zip(blocks, np.cumsum(sizes).tolist(), sizes, strict=True):
            whole[end - n : end - n + len(b)] = b
        self.put(name, whole)

    def get_all(self, name: str) -> dict[str, np.ndarray]:
        """What put_all wrote, in one mapping: one handle."""
        whole = self.get(name)
        n = int.from_bytes(whole[:8].tobytes(), "little")
        at, out = 64 + -(-n // 64) * 64, {}
        for k, kind, size in json.loads(whole[64 : 64 + n].tobytes()):
            a = whole[at : at + size * np.dtype(kind).itemsize].view(kind)
            out[k], at = a, at + -(-a.nbytes // 64) * 64
        return out


@lru_cache(maxsize=32)
def _copied(uri: str, name: str) -> np.ndarray:
    """A mapped copy of a file of the store with this URI. It is unlinked at once, and gone when nothing maps it any more."""
    store = Store(uri)
    with tempfile.NamedTemporaryFile(suffix=".npy") as f:
        with store.fs.open_input_stream(f"{store.path}/{name}.npy") as src:
            while data := src.read(16 << 20):
                f.write(data)
        f.flush()
        return np.load(f.name, mmap_mode="r")


class RowSet:
    """Some rows of a written table, by row_id as monotonically_increasing_id gave it before the table was written.

    The rows that one task wrote are one array in the shared folder. Files of the table keep rows together that were
    written together, so a task that reads it looks into the arrays of its own rows only, however large the table is.
    """

    def __init__(self, folder: str, filled: frozenset):
        self.folder, self.filled = folder, filled

    @classmethod
    def write(cls, ids: DataFrame, name: str, scratch: Scratch) -> RowSet:
        """ids: a column row_id; each once."""
        spark = ids.sparkSession
        folder = shared_folder(spark, name)
        scratch.paths.append(folder)

        def put(batches):
            held: list[np.ndarray] = []
            for b in batches:
                if b.num_rows:
                    held.append(np.asarray(b.column(1)))
            if not held:
                return
            ids = np.sort(np.concatenate(held))
            part, first = np.unique(ids >> 33, return_index=True)
            for p, x in zip(part.tolist(), np.split(ids, first[1:]), strict=True):
                Store(folder).put(str(p), x)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64())], ["part"])

        made = ids.select(F.shiftright("row_id", 33).alias("part"), "row_id").repartition("part").mapInArrow(put, "part long")
        return cls(folder, frozenset(r["part"] for r in made.collect()))  # a row for each task that wrote the table

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """For a task: tells of row ids whether they are in the set. An array that can't be read is an error."""
        store, arrays = Store(self.folder), {}

        def among(ids: np.ndarray) -> np.ndarray:
            found = np.zeros(len(ids), bool)
            for p in self.filled.intersection(np.unique(ids >> 33).tolist()):
                if p not in arrays:
                    arrays.clear()
                    arrays[p] = store.get(str(p))
                at = np.flatnonzero(ids >> 33 == p)
                a = arrays[p]
                found[at] = a[np.minimum(np.searchsorted(a, ids[at]), len(a) - 1)] == ids[at]
            return found

        return among

    def filter(self, df: DataFrame) -> DataFrame:
        """The rows of df (a column row_id) that are in the set, unchanged."""
        small_batches(df.sparkSession)

        def run(batches):
            among = self.reader()
            for b in batches:
                yield b.filter(pa.array(among(np.asarray(b.column("row_id")))))

        return df.mapInArrow(run, df.schema)


class _Writer:
    def __init__(self, f):
        self.f = f

    def write(self, data) -> None:
        self.f.write(bytes(data))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part that a 64-bit hash belongs to: equal stretches of the hash space."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def release() -> None:
    """Gives freed memory back to the system, so that a worker's next task starts small. For the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `limit` bytes of text, or a single row."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    fields: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Applies a function of a list of texts (null: empty) to a table, by batches, without a shuffle.

    make: called once in each task; gives the function, whose result has a list for each of the fields.
    Only id and text columns are read, so other columns can't clash; an id column named as a field gets `_key` appended.
    """
    small_batches(df.sparkSession)
    names = [x.split()[0].strip("`") for x in _split_fields(fields)]
    key = id_col if id_col not in names else f"{id_col}_key"
    src = df.select(df[id_col].alias("__id"), df[text_col].cast("string").alias("text"))
    kind = src.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for whole in batches:
            for batch in slices(whole):
                f = f or make()
                out = f([x or "" for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("__id"), *(_array(out[n]) for n in names)], [key, *names])
        release()

    return src.mapInArrow(run, f"`{key}` {kind}, {fields}")


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def _split_fields(fields: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(fields[start:i].strip())
            start = i + 1
    return [*out, fields[start:].strip()]


class WordHashes:
    """64-bit hashes of words (bytes), kept for the words met so far; long words aren't kept, so the store is bounded by bytes."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.known: dict[bytes, int] = {}
        self.entries = entries

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            h = xxhash.xxh64_intdigest
            new = set(words).difference(known)
            if len(known) + len(new) > self.entries:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = h(w)
            out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            if len(known) > self.entries:
                known.clear()
            for w in new:
                if len(w) > CACHED_BYTES:
                    known.pop(w, None)
            return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads each bit of the input over all bits of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: each item's run, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - starts[run]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def letters_lower(text: str) -> bytes:
    """UTF-8 of a text, lone surrogates replaced, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower()
