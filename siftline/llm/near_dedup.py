"""MinHash near-dedup by ProbMinHash.

Each five-word shingle is a Poisson process whose rate is its weight; arrivals pick registers, a register keeps its
earliest arrival, and a process ends when it is later than all registers. Equal registers estimate the probability
Jaccard similarity. All distinct shingles of a document weigh the same here, however often they occur: then it is the
Jaccard similarity of the sets, the one that decides. Bands of registers give candidates, an estimate from more registers
drops the distant ones, and the Jaccard similarity of the whole sets of shingles decides.

Shingles stand in no table: they are made once for the signatures, and again for texts with candidates. Copies with the
same shingles are one node from the start. What a bucket or a group of candidates yields is a forest of
its links, never all its pairs; large ones are cut into blocks that meet two by two.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RowSet, Scratch, WordHashes, flat, gather, letters_lower, mix, release, slices, small_batches, table, written
from .components import connected_components, grouped, in_blocks, spanning_edges, whole_groups

SHINGLE = 5
SIMILAR = 0.8
#: At a similarity of 0.8 some band of 32 agrees in all its 5 registers with a probability over 0.999995.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Registers of which a byte is kept for the estimate, and the estimate that a candidate needs: at a similarity of 0.8
#: five standard deviations below it.
SKETCH, ESTIMATE = 96, 0.6
#: Bytes of text hashed together: about 60 bytes of memory for each.
TOGETHER = 1 << 19
#: Members of a block of a large bucket, and of a large group of candidates.
BUCKET_BLOCK, GROUP_BLOCK = 4000, 1000

#: Letters of scripts that set no blanks between words (Thai to Khmer, kana, Han): each is a word of its own.
_ALONE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str) -> list[bytes]:
    return letters_lower(text if text.isascii() else _ALONE.sub(r" \g<0> ", text)).split()


def shingles(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of distinct shingles, by text and hash. A text of fewer words is one shingle; of none, none."""
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = hashes([w for x in words for w in x])
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    row, at = flat(size)
    first = (np.cumsum(n) - n)[row] + at
    out = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < n[row]
        out = mix(out * np.uint64(0x100000001B3) + np.where(inside, h[np.minimum(first + k, max(len(h) - 1, 0))], np.uint64(k)) if len(h) else out)
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (out[1:] != out[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], out[new], np.diff(np.append(new, len(row)))


def prob_min_hash(row: np.ndarray, items: np.ndarray, weights: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """(rows, registers): the item that came first in each register; rows without items get zeros.

    All processes go on together, in rounds of one, two, four and more arrivals; those later than all of their row's
    registers stop.
    """
    best = np.full(rows * registers, np.inf)
    won = np.zeros(rows * registers, np.uint64)
    live, time, arrival, many = np.arange(len(items)), np.zeros(len(items)), 0, 1
    while len(live):
        seed = items[live][:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(arrival + 1, arrival + many + 1).astype(np.uint64))[None]
        r = mix(seed)
        gaps = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weights[live][:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        latest = best.reshape(rows, registers).max(axis=1)
        use = times < latest[row[live]][:, None]
        where = (mix(r ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        slot = (row[live][:, None] * registers + where.astype(np.int64))[use]
        t, item = times[use], np.broadcast_to(items[live][:, None], times.shape)[use]
        better = t < best[slot]
        slot, t, item = slot[better], t[better], item[better]
        np.minimum.at(best, slot, t)
        first = t == best[slot]
        won[slot[first]] = item[first]
        latest = best.reshape(rows, registers).max(axis=1)
        go = times[:, -1] < latest[row[live]]
        live, time = live[go], times[go, -1]
        arrival += many
        many = min(many * 2, 64)
    return won.reshape(rows, registers)


def band_keys(won: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(won), BANDS)).copy()
    for k in range(ROWS):
        out = mix(out * np.uint64(0x100000001B3) + won.reshape(len(won), BANDS, ROWS)[:, :, k])
    return out


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """row (a struct of id and text, or of all columns), row_id, set_hash, bands and sketch of each text; the last three are
    null where it has no word.

    Sets of shingles aren't kept: of the few texts that have candidates they are made again.
    """
    small_batches(docs.sparkSession)
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)) if whole else F.struct(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    src = docs.select(row.alias("row"), docs[text_col].cast("string").alias("__text"))

    def run(batches):
        hashes = WordHashes()
        for all_ in batches:
            for b in slices(all_, "__text", TOGETHER):
                n = b.num_rows
                row, items, _ = shingles([t or "" for t in b.column("__text").to_pylist()], hashes)
                won = prob_min_hash(row, items, np.ones(len(items)), n)
                size = np.bincount(row, minlength=n)
                start = np.cumsum(size) - size
                data = items.astype("<u8").tobytes()
                digest = [xxhash.xxh3_128_digest(data[8 * a : 8 * (a + k)]) if k else None for a, k in zip(start.tolist(), size.tolist(), strict=True)]
                keys = band_keys(won).view(np.int64)
                sketch = (won[:, :SKETCH] & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("row"),
                        pa.array(digest, pa.binary()),
                        pa.array([k if d else None for d, k in zip(digest, keys, strict=True)], pa.list_(pa.int64())),
                        pa.array([k.tobytes() if d else None for d, k in zip(digest, sketch, strict=True)], pa.binary()),
                    ],
                    ["row", "set_hash", "bands", "sketch"],
                )
        release()

    schema = T.StructType([src.schema["row"], T.StructField("set_hash", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return src.mapInArrow(run, schema).withColumn("row_id", F.monotonically_increasing_id())


def _sets_of(rows: DataFrame, chosen: RowSet) -> DataFrame:
    """row_id and shingles (sorted 64-bit hashes) of the chosen rows (columns row_id, text); others leave where they are read."""
    small_batches(rows.sparkSession)

    def run(batches):
        hashes, of_interest = WordHashes(), chosen.reader()
        for all_ in batches:
            for b in slices(all_.filter(pa.array(of_interest(np.asarray(all_.column("row_id"))))), limit=TOGETHER):
                row, items, _ = shingles([t or "" for t in b.column("text").to_pylist()], hashes)
                ends = np.cumsum(np.bincount(row, minlength=b.num_rows)).tolist()
                data = items.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array([data[8 * a : 8 * z] for a, z in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["row_id", "shingles"])
        release()

    return rows.select("row_id", "text").mapInArrow(run, "row_id long, shingles binary")


def _forest(tasks: DataFrame, column: str, make) -> DataFrame:
    """Edges (a, b) from each task's members. make: (values, bounds) -> like(i, others) for one group of them."""

    def run(batches):
        for t, bounds in whole_groups(batches, "task_key"):
            ids, block, own = (t.column(c).to_numpy() for c in ("row_id", "block", "own"))
            values = t.column(column).combine_chunks()
            a, b = [], []
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if y - x > 1:
                    for i, j in spanning_edges(y - x, make(values[x:y]), None if own[x] else block[x:y]):
                        a.append(ids[x + i])
                        b.append(ids[x + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release()

    keyed = tasks.select(F.xxhash64("task").alias("task_key"), "row_id", "block", "own", column)
    return grouped(keyed, "task_key").mapInArrow(run, "a long, b long")


def _by_sketch(values: pa.Array):
    s = np.frombuffer(b"".join(v.as_py() for v in values), np.uint8).reshape(len(values), SKETCH)
    return lambda i, others: (s[others] == s[i]).mean(axis=1) >= ESTIMATE


def _by_sets(similar: float):
    def make(values: pa.Array):
        sets = [np.frombuffer(v.as_py(), "<u8") for v in values]
        size = np.array([len(s) for s in sets], np.int64)
        start = np.cumsum(size) - size
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(int(ids.max()) + 1, np.int64)

        def like(i: int, others: np.ndarray) -> np.ndarray:
            ok = np.minimum(size[others], size[i]) >= similar * np.maximum(size[others], size[i]) - 1e-9
            near = others[ok]
            if len(near):
                mine = ids[start[i] : start[i] + size[i]]
                mark[mine] = 1
                n = size[near]
                common = np.add.reduceat(mark[ids[gather(start[near], n)]], np.cumsum(n) - n)
                mark[mine] = 0
                ok[ok] = common >= similar * (n + size[i] - common) - 1e-9
            return ok

        return like

    return make


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept for each row: classes are the components of links of a similarity of `similar` or more.

    class_id is the smallest doc_id of the class; `kept` is true for one row of each class, one with that id. Texts
    without a word (null, empty) link with nothing and are classes of their own. Texts of one to four words are one
    shingle, and so link with equal ones only. Words stand between ASCII white space; letters of scripts without blanks are
    words by themselves. Repeated rows, with equal ids or not, are rows of one class. An empty table
    gives an empty result. The ids come back as doc_id.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(signed(docs, id_col, text_col), "signatures")
    out = _classes(rows, F.col("row.id"), F.col("row.text"), similar, scratch)
    scratch.clear()
    return out.select("doc_id", "class_id", "class_size", "kept")


def _classes(sig: DataFrame, doc_id: Column, text: Column, similar: float, scratch: Scratch) -> DataFrame:
    """doc_id, row_id, class_id, class_size and kept of each row of sig, a written table as `signed` makes it."""
    # All sides of joins grow with the table: none is broadcast, at no size. Skewed left sides are split at run time.
    # One node for each set of shingles. Partial aggregation comes before the shuffle, so many copies cost little.
    worded = sig.filter("set_hash IS NOT NULL")
    nodes = scratch.write(worded.groupBy("set_hash").agg(F.min("row_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")

    keys = nodes.select(F.col("node").alias("row_id"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = scratch.write(keys.join(shared.hint("merge"), "key", "left_semi").select("key", "row_id"), "bucket-members")
    # Buckets with the same members are needed once.
    buckets = (
        members.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("row_id").alias("least"), F.max("row_id").alias("most"), F.bit_xor(F.xxhash64("row_id")).alias("x"), F.bit_xor(F.xxhash64(F.col("row_id") + 1)).alias("y"))
        .groupBy("n", "least", "most", "x", "y")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    members = scratch.write(members.join(buckets.hint("merge"), "key"), "distinct-buckets")
    sketches = nodes.select(F.col("node").alias("row_id"), "sketch")
    tasks = in_blocks(members, "key", "row_id", BUCKET_BLOCK, scratch).join(sketches.hint("merge"), "row_id")
    candidates = connected_components(_forest(tasks, "sketch", _by_sketch), scratch)
    candidates = scratch.write(candidates.withColumnRenamed("id", "row_id"), "candidates")

    sets = _sets_of(sig.select("row_id", text.alias("text")), RowSet.write(candidates.select("row_id"), "candidate-ids", scratch))
    tasks = in_blocks(candidates, "component", "row_id", GROUP_BLOCK, scratch).join(sets.hint("merge"), "row_id")
    links = connected_components(_forest(tasks, "shingles", _by_sets(similar)), scratch)
    links = links.select(F.col("id").alias("node"), "component")

    roots = nodes.join(links.hint("merge"), "node", "left").select("set_hash", F.coalesce("component", "node").alias("root"))
    ids = sig.select(doc_id.alias("doc_id"), "row_id", "set_hash")
    worded = ids.filter("set_hash IS NOT NULL").join(roots.hint("merge"), "set_hash").select("doc_id", "row_id", "root")
    wordless = ids.filter("set_hash IS NULL").select("doc_id", "row_id", F.col("row_id").alias("root"))
    rows = written(worded.unionByName(wordless), "roots")
    classes = rows.groupBy("root").agg(F.min(F.struct("doc_id", "row_id")).alias("first"), F.count("*").alias("class_size"))
    return rows.join(classes.hint("merge"), "root").select("doc_id", "row_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, unchanged, of which near_duplicates keeps one of each class, whether ids are unique or not.

    docs is written once with a number for each row, and decided row by row; whole rows aren't shuffled, the kept ones
    are picked where that table is read. scratch: takes the tables that the result still reads, to be cleared after it;
    without it they last until the driver ends.
    """
    lasting, passing = scratch or Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    sig = lasting.write(signed(docs, id_col, text_col, whole=True), "signatures")
    classes = _classes(sig, F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`").cast("string"), similar, passing)
    kept = RowSet.write(classes.filter("kept").select("row_id"), "kept-rows", lasting)
    passing.clear()
    return kept.filter(sig.select("row_id", "row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
