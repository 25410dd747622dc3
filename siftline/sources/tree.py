"""Source trees as a Spark data source: tasks walk folders, each with the ignore rules that hold above it."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftline.sources.files import MAX_BYTES, Ignored, entries, is_plain_scannable, read_text

SCHEMA = "file string, text string, modified timestamp"
#: Folders that the driver opens before tasks take over, and rows of an Arrow batch.
SPLITS, BATCH_ROWS = 256, 64


@dataclass
class Part(InputPartition):
    """A folder with all below it, or (deep false) some files alone; rules: of the ignore files above."""

    paths: tuple[str, ...]
    rules: tuple[Ignored, ...]
    deep: bool
    since: int = -1
    until: int = 1 << 62


class _Tree:
    """Options: path (several by `;`), hidden (true), maxBytes, splits (folders opened by the driver)."""

    def __init__(self, options: dict[str, str]):
        self.roots = [p for p in options.get("path", ".").split(";") if p]
        self.hidden = options.get("hidden", "true").lower() != "false"
        self.max_bytes = int(options.get("maxBytes", options.get("maxbytes", MAX_BYTES)))
        self.splits = int(options.get("splits", SPLITS))

    def parts(self, since: int = -1, until: int = 1 << 62) -> list[Part]:
        """Opens folders, the upper ones first, until there are enough to deal out."""
        alone = tuple(r for r in self.roots if os.path.isfile(r) and is_plain_scannable(r))
        files, queue = [Part(alone, (), False, since, until)] if alone else [], [(r, ()) for r in self.roots if not os.path.isfile(r)]
        at = 0
        while at < len(queue) and len(queue) - at < self.splits:
            folder, rules = queue[at]
            at += 1
            below, names, rules = entries(folder, rules, self.hidden)
            queue += [(f, rules) for f in below]
            if names:
                files.append(Part(tuple(names), rules, False, since, until))
        return [*files, *(Part((f,), rules, True, since, until) for f, rules in queue[at:])]

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for path in self._files(part):
            try:
                stat = os.stat(path)
            except OSError:
                continue
            if part.since < stat.st_mtime_ns // 1000 <= part.until:
                held.append((path, read_text(path, self.max_bytes), stat.st_mtime_ns // 1000))
            if len(held) >= BATCH_ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _files(self, part: Part) -> Iterator[str]:
        if not part.deep:
            yield from part.paths
            return
        todo = [(p, part.rules) for p in part.paths]
        while todo:
            folder, rules = todo.pop()
            below, names, rules = entries(folder, rules, self.hidden)
            yield from names
            todo += [(f, rules) for f in reversed(below)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "text", "modified"])


class _Reader(DataSourceReader):
    def __init__(self, tree: _Tree):
        self.tree = tree

    def partitions(self) -> list[Part]:
        return self.tree.parts() or [Part((), (), False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are times: a batch holds what was modified after one and up to the next. Nothing is listed for an offset.

    A file that comes with an older time than the last offset (moved there) isn't seen, nor one modified later than now.
    """

    def __init__(self, tree: _Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"us": -1}

    def latestOffset(self) -> dict:
        return {"us": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.tree.parts(start["us"], end["us"]) or [Part((), (), False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """spark.read.format("source_tree").load(folder): the rows of files.source_tree, with times; also for readStream.

    For file systems that every worker mounts. Null texts: empty, too large or unreadable files.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(_Tree(dict(self.options)))

    def streamReader(self, schema) -> _Stream:
        return _Stream(_Tree(dict(self.options)))
