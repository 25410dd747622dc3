"""Files as a table of texts.

Spark's own listing drops names that start with a dot or an underscore, so source trees are walked on the driver (names
only); reading is distributed. Lakes of plain data files can use `lake_files`, which Spark lists and prunes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from siftline.operators.suppress import Rules, is_file_skipped

#: Files of more bytes are left unread.
MAX_BYTES = 1_000_000

# Names of files and folders that are never scanned.
SKIPPED_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "lock", "pyc", "pyo", "so", "dylib", "bin", "pdf", "zip", "tar", "gz", "tgz", "bz2", "xz", "7z", "jar", "war", "ear",
    "class", "o", "a", "mo", "mp3", "mp4", "avi", "mov", "wmv", "flv", "webm", "webp", "bmp", "tiff", "psd",
)
SKIPPED_FOLDERS = ("node_modules", ".venv", "venv", ".git", "dist", "build", "target", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".baselines")


def is_scannable(path: Column) -> Column:
    """By extension (any case; a name's leading dot starts none) and by folders on the path."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    return ~ext.isin(*SKIPPED_EXTENSIONS) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def is_plain_scannable(path: str) -> bool:
    m = re.search(r"[^/.][^/]*\.([^./]+)$", path)
    return not (m and m[1].lower() in SKIPPED_EXTENSIONS) and not set(path.split("/")) & set(SKIPPED_FOLDERS)


class Ignored:
    """Rules of one ignore file, for paths below its folder."""

    def __init__(self, folder: str, lines: Iterable[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = line.rstrip("\r\n")
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            line = line[1:] if line.startswith(("\\#", "\\!")) else line
            only_folders = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(_ignore_regex(line.lstrip("/"), anchored)), keep, only_folders))

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        rel = os.path.relpath(path, self.folder).replace(os.sep, "/")
        out = None
        for regex, keep, only_folders in self.rules:
            if (is_folder or not only_folders) and regex.search(rel):
                out = not keep
        return out


def _ignore_regex(pattern: str, anchored: bool) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + "$"


def walk(roots: Iterable[str] = (), include_hidden: bool = True) -> list[str]:
    """Paths of regular files below the roots (default: here) that ignore files and skip lists leave; unreadable ones are passed over."""
    out = []
    for root in [str(r) for r in roots] or ["."]:
        if os.path.isfile(root):
            out += [root] if is_plain_scannable(root) else []
            continue
        _walk(root, (), include_hidden, out)
    return out


def _walk(folder: str, above: tuple[Ignored, ...], include_hidden: bool, out: list[str]) -> None:
    below, names, rules = entries(folder, above, include_hidden)
    out += names
    for f in below:
        _walk(f, rules, include_hidden, out)


def entries(folder: str, above: tuple[Ignored, ...], include_hidden: bool = True) -> tuple[list[str], list[str], tuple[Ignored, ...]]:
    """Folders and files right in a folder, by name, that ignore files and skip lists leave; and the rules that hold below it."""
    rules = list(above)
    for name in (".gitignore", ".ignore", ".git/info/exclude"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                rules.append(Ignored(folder, f))
        except OSError:
            pass
    folders: list[str] = []
    files: list[str] = []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return folders, files, tuple(rules)
    for e in found:
        path = os.path.join(folder, e.name)
        if e.name in SKIPPED_FOLDERS or (not include_hidden and e.name.startswith(".")):
            continue
        is_folder = e.is_dir(follow_symlinks=False)
        if next((v for r in reversed(rules) if (v := r.verdict(path, is_folder)) is not None), False):
            continue
        if is_folder:
            folders.append(path)
        elif e.is_file(follow_symlinks=False) and is_plain_scannable(path):
            files.append(path)
    return folders, files, tuple(rules)


def read_text(path: str, max_bytes: int = MAX_BYTES) -> str | None:
    """Null where a file is empty, too large or unreadable. Bytes that aren't UTF-8 become U+FFFD."""
    try:
        if 0 < os.stat(path).st_size <= max_bytes:
            return Path(path).read_bytes().decode("utf-8", "replace")
    except OSError:
        pass
    return None


def read_files(spark: SparkSession, paths: Iterable[str], rules: Rules | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """file and text for each path, on a file system that every worker mounts. text is null where a file is empty, too
    large, unreadable, or skipped by a rule (then it isn't read). Bytes that aren't UTF-8 become U+FFFD."""
    names = spark.createDataFrame([(str(p), os.path.abspath(p)) for p in paths], "file string, path string")
    names = names.repartition(max(1, spark.sparkContext.defaultParallelism))
    names = names.withColumn("read", ~is_file_skipped(F.col("file"), rules or Rules()))

    def run(batches):
        for b in batches:
            texts = [read_text(path, max_bytes) if read else None for path, read in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["file", "text"])

    return names.mapInArrow(run, "file string, text string")


def source_tree(spark: SparkSession, roots: Iterable[str] = (), rules: Rules | None = None, include_hidden: bool = True) -> DataFrame:
    return read_files(spark, walk(roots, include_hidden), rules)


def lake_files(spark: SparkSession, path: str, rules: Rules | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """file and text of all files below a path of any file system; sizes and names are pruned before a byte is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = df.filter(F.col("length").between(1, max_bytes) & is_scannable(F.col("path")) & ~is_file_skipped(F.col("path"), rules or Rules()))
    return kept.select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    return F.call_function("make_valid_utf8", content.cast("string"))


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """files whose path is in changed (column file); blank lines don't count. The skip lists apply to them too."""
    names = changed.filter(F.trim("file") != "").select("file").filter(is_scannable(F.col("file"))).distinct()
    return files.join(names, "file", "left_semi")


