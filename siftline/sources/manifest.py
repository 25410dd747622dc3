"""What changed, by content: digests of files and folders, compared without reading what stayed the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(docs: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """file, folder and digest (SHA-256; null for a null text): a row for each row of docs, without a shuffle."""
    file = docs[id_col].cast("string")
    folder = F.when(F.contains(file, F.lit("/")), F.regexp_replace(file, "/[^/]*$", "")).otherwise("")
    return docs.select(file.alias("file"), folder.alias("folder"), F.sha2(docs[text_col].cast("string").cast("binary"), 256).alias("digest"))


def folder_digests(files: DataFrame) -> DataFrame:
    """folder, n and two 64-bit sums over the files right in it: equal for equal contents, in any order.

    Sums are made before the shuffle, so a folder of any size is no task of its own.
    """
    one = F.xxhash64("file", "digest")
    two = F.xxhash64(F.lit("b"), "digest", "file")
    return files.groupBy("folder").agg(F.count("*").alias("n"), F.bit_xor(one).alias("a"), F.sum(F.shiftright(two, 16)).alias("b"))


def changed_since(now: DataFrame, before: DataFrame) -> DataFrame:
    """file and change ('added', 'changed', 'removed') between two manifests (of which each file is in one row).

    Folders whose digests agree are left by one comparison; only files of the others meet. Null digests are equal.
    """
    mine, theirs = folder_digests(now), folder_digests(before)
    same = mine.join(theirs, ["folder", "n", "a", "b"], "left_semi").select("folder")
    left = lambda files, name: files.join(same, "folder", "left_anti").select("file", F.struct("digest").alias(name))
    both = left(now, "now").join(left(before, "before"), "file", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("now.digest").eqNullSafe(F.col("before.digest")), "changed")
    return both.select("file", change.alias("change")).filter(F.col("change").isNotNull())


def only_changed_content(docs: DataFrame, before: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """The rows of docs that a manifest doesn't hold with the same content. Names meet, texts stay where they are read."""
    names = changed_since(manifest(docs, id_col, text_col), before).filter("change <> 'removed'").select(F.col("file").alias("__file"))
    return docs.join(names, docs[id_col].cast("string") == F.col("__file"), "left_semi")
