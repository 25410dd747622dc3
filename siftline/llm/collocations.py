"""Phrase collocation mining: sketches bound counts from above, automata count what the bounds leave, thresholds follow.

Words are counted by task and summed. Two count-min sketches follow, of pairs of frequent words, and of phrases of three words
and more whose pairs may be frequent; tasks send the cells they touched, a part of the cells is summed in one place and
kept as a bit for each cell: may it be frequent. Phrases that pass are the candidates; none that is frequent is missed. They are
compiled into Aho-Corasick automata of bounded size, each phrase between delimiters, and every text is scanned by each
of them; sums of the matches are exact counts. Scores and filters are joins over phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Store, mix, part_of, release, shared_folder, slices, small_batches, table
from .lm_score import pack_arrays, unpack_arrays

LONGEST, LEAST, TOP, INSIDE_PERCENT = 5, 100, 2000, 100
STOP = b"."
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(STOP[0] if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Cells of a part of a sketch as a power of two, rows of cells, and words of text for each cell of a row.
CELL_BITS, ROWS, WORDS_A_CELL = 23, 2, 4
#: Keys that a task counts before it sends cells, and distinct words before it sends counts.
FLUSH_KEYS, FLUSH_WORDS = 3_000_000, 400_000
#: Bytes of phrases for each automaton, and frequent words for each file of them.
AUTOMATON_BYTES, WORDS_A_FILE = 6 << 20, 4_000_000
#: Splits of a table that one task of the later passes reads: each task sends a phrase, or its count, once.
SPLITS_A_TASK = 8
#: Words whose hashes a task keeps.
KEPT_WORDS = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str) -> list[bytes]:
    """The words of a text, with a full stop where a piece ends."""
    return text.encode("utf-8", "replace").translate(_PLAIN).replace(STOP, b" . ").split()


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words and stops) of some megabytes of texts at a time; columns lang and text."""
    for whole in batches:
        for batch in slices(whole):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    got = texts.setdefault(lang, [])
                    got += pieces(text)
                    got.append(STOP)
            yield from texts.items()


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word (null: all words), n."""
    most = FLUSH_WORDS

    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            out = [(lang, w, n) for lang, c in held.items() for w, n in [(None, c.total()), *c.items()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()).cast(pa.string()), pa.array([r[2] for r in out], pa.int64())], ["lang", "word", "n"])

        for lang, words in by_lang(batches):
            count = held.setdefault(lang, Counter())
            count.update(words)
            del count[STOP]
            if sum(map(len, held.values())) > most:
                yield rows()
        yield rows()
        release()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), seed=11))


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    return mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) ^ salt(lang))


@dataclass(frozen=True)
class Keys:
    """Sorted keys of frequent words, in files by stretches of the hash space."""

    folder: str
    parts: int

    @classmethod
    def write(cls, words: DataFrame, folder: str) -> Keys:
        parts = max(1, -(-words.count() // WORDS_A_FILE))

        def keys(batches):
            for b in batches:
                k = np.zeros(b.num_rows, np.uint64)
                langs = np.array(b.column("lang").to_pylist(), object)
                at = np.array([w.encode() for w in b.column("word").to_pylist()], object)
                for lang in set(langs.tolist()):
                    k[langs == lang] = word_keys(lang, at[langs == lang].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(part_of(k, parts), pa.int32()), pa.array(k.view(np.int64))], ["part", "key"])

        def put(batches):
            held = [np.zeros(0, np.uint64), *(np.asarray(b.column(1)).view(np.uint64) for b in batches)]
            Store(folder).put(f"words-{TaskContext.get().partitionId()}", np.unique(np.concatenate(held)))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["part"])

        words.select("lang", "word").mapInArrow(keys, "part int, key long").repartitionById(parts, F.col("part")).mapInArrow(put, "part int").count()
        return cls(folder, parts)

    def among(self, keys: np.ndarray) -> np.ndarray:
        out, part, store = np.zeros(len(keys), bool), part_of(keys, self.parts), Store(self.folder)
        for p in np.unique(part).tolist():
            a, at = store.get(f"words-{p}"), np.flatnonzero(part == p)
            if len(a):
                out[at] = a[np.minimum(np.searchsorted(a, keys[at]), len(a) - 1)] == keys[at]
        return out


class Lookup:
    """For words of a language: their hashes, the lowest bit telling whether they are frequent; 0 for a stop."""

    def __init__(self, keys: Keys, kept: int):
        self.keys, self.kept, self.known, self.size = keys, kept, {}, 0

    def __call__(self, lang: str, words: list[bytes]) -> np.ndarray:
        known = self.known.setdefault(lang, {STOP: 0})
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            new = list(set(words).difference(known))
            if self.size + len(new) > self.kept:
                self.known, self.size = {lang: (known := {STOP: 0})}, 0
                new = list(set(words) - {STOP})
            k = word_keys(lang, new)
            known.update(zip(new, ((k & ~np.uint64(1)) | self.keys.among(k).astype(np.uint64)).tolist(), strict=True))
            self.size += len(new)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def phrases(h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, key, are all words frequent) of the phrases that start at each place, of two words on."""
    ok = first = (h & np.uint64(1)) == 1
    g = h
    for m in range(2, LONGEST + 1):
        if len(h) < m:
            return
        g, ok = mix(g[:-1] * _STEP + h[m - 1 :]), ok[:-1] & first[m - 1 :]
        yield m, g, ok


@dataclass(frozen=True)
class Sketch:
    """Bits of cells that may be frequent, in ROWS rows; files by part of a row. No parts: nothing was counted."""

    folder: str
    parts: int
    bits: int = CELL_BITS

    def cells(self, keys: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        k = keys if row == 0 else mix(keys + np.uint64(row))
        return part_of(k, self.parts), (k & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out, store = np.full(len(keys), self.parts > 0), Store(self.folder)
        for row in range(ROWS if self.parts else 0):
            part, cell = self.cells(keys, row)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p) if self.parts > 1 else slice(None)
                bits = store.get(f"{row}-{p}")  # let go at once: an open file takes a handle
                out[at] &= (bits[cell[at] >> 3] >> (cell[at] & 7) & 1).astype(bool)
        return out

    def fill(self, docs: DataFrame, keys_of: Callable[[], Callable[[str, list[bytes]], list[np.ndarray]]], least: int) -> Sketch:
        """Counts the keys of all texts. Counts stop at `least`, which is all that is asked of them."""
        kind, most = "<u1" if least < 256 else "<u4", FLUSH_KEYS

        def touched(batches):
            keys, held, size = keys_of(), [], 0

            def rows():
                ids, blobs = [], []
                for row in range(ROWS):
                    part, cell = self.cells(np.concatenate(held), row)
                    cell, n = np.unique(part << self.bits | cell, return_counts=True)
                    at = np.flatnonzero(np.diff(cell >> self.bits, prepend=-1)).tolist()
                    for a, b in zip(at, [*at[1:], len(cell)], strict=True):
                        ids.append(row * self.parts + int(cell[a] >> self.bits))
                        c = cell[a:b] & ((1 << self.bits) - 1)
                        blobs.append(pack_arrays(np.bincount(c >> 16, minlength=1 << (self.bits - 16)).astype("<u4"), (c & 0xFFFF).astype("<u2"), np.minimum(n[a:b], least).astype(kind)))
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["id", "block"])

            for lang, words in by_lang(batches):
                got = keys(lang, words)
                held += got
                size += sum(map(len, got))
                if size >= most:
                    yield rows()
                    held, size = [], 0
            if size:
                yield rows()
            release()

        def summed(batches):
            sums, i, blocks = np.zeros(1 << self.bits, "<u4"), TaskContext.get().partitionId(), 0
            for b in batches:
                for block in b.column(1).to_pylist():
                    high, low, n = unpack_arrays(block)
                    cell = np.repeat(np.arange(len(high)) << 16, high) | low
                    sums[cell] = np.minimum(sums[cell] + n, least)
                    blocks += 1
            Store(self.folder).put(f"{i // self.parts}-{i % self.parts}", np.packbits(sums >= least, bitorder="little"))
            yield pa.RecordBatch.from_arrays([pa.array([blocks], pa.int64())], ["blocks"])
            release()

        made = docs.mapInArrow(touched, "id int, block binary").repartitionById(ROWS * self.parts, F.col("id")).mapInArrow(summed, "blocks long")
        return self if made.agg(F.sum("blocks")).first()[0] else Sketch(self.folder, 0)


def pair_keys(keys: Keys):
    kept = KEPT_WORDS

    def make():
        lookup = Lookup(keys, kept)

        def run(lang, words):
            return [g[ok] for m, g, ok in phrases(lookup(lang, words)) if m == 2]

        return run

    return make


def _may(pairs: Sketch, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """phrases, of which those stay all of whose pairs may be frequent."""
    two = None
    for m, g, ok in phrases(h):
        if m == 2:
            two = ok.copy()
            two[ok] = pairs.passes(g[ok])
            left = two
        else:
            left = left[:-1] & two[m - 2 :]
        yield m, g, left


def longer_keys(keys: Keys, pairs: Sketch):
    kept = KEPT_WORDS

    def make():
        lookup = Lookup(keys, kept)
        return lambda lang, words: [g[ok] for m, g, ok in _may(pairs, lookup(lang, words)) if m > 2]

    return make


def in_few_tasks(docs: DataFrame) -> DataFrame:
    """docs, several splits to a task but a task for each core: for passes whose tasks each send most phrases there are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(cores, -(-docs.rdd.getNumPartitions() // SPLITS_A_TASK)))


def candidates(docs: DataFrame, keys: Keys, pairs: Sketch, longer: Sketch) -> DataFrame:
    """lang, phrase: all that may be frequent, each once."""
    most, kept = 2 * FLUSH_WORDS, KEPT_WORDS

    def run(batches):
        lookup, seen = Lookup(keys, kept), set()
        for lang, words in by_lang(batches):
            out: list[bytes] = []
            inner = None
            for m, g, ok in _may(pairs, lookup(lang, words)):
                if m > 2:
                    ok = ok & inner[:-1] & inner[1:]
                    ok[ok] = longer.passes(g[ok])
                inner = ok
                at = np.flatnonzero(ok)
                key, first = np.unique(g[at], return_index=True)
                for k, i in zip(key.tolist(), at[first].tolist(), strict=True):
                    if k not in seen:
                        seen.add(k)
                        out.append(b" ".join(words[i : i + m]))
            if len(seen) > most:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.binary()).cast(pa.string())], ["lang", "phrase"])
        release()

    return in_few_tasks(docs).mapInArrow(run, "lang string, phrase string").distinct()


def compiled(found: DataFrame, folder: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """Writes phrases in files, one for each automaton; (id, lang, phrase) and the number of files.

    Languages lie end to end by bytes, and a phrase falls anywhere in its language's stretch, by its hash.
    """
    found = scratch.write(found, "phrase-candidates")
    size = F.sum(F.octet_length("phrase")).alias("bytes")
    of_lang = found.groupBy("lang").agg(size).withColumn("end", F.sum("bytes").over(Window.orderBy("lang")))  # a row for each language
    files = -(-(of_lang.agg(F.max("end")).first()[0] or 0) // AUTOMATON_BYTES)
    share = F.pmod(F.xxhash64("phrase"), F.lit(1 << 20)) / (1 << 20)
    cut = found.join(of_lang, "lang").withColumn("file", F.floor((F.col("end") - F.col("bytes") + share * F.col("bytes")) / AUTOMATON_BYTES).cast("int"))

    def put(batches):
        f = TaskContext.get().partitionId()
        t = pa.Table.from_batches([b.select(["lang", "phrase"]) for b in batches], pa.schema([("lang", pa.string()), ("phrase", pa.string())]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        Store(folder).put(f"phrases-{f}", np.frombuffer(sink.getvalue(), np.uint8))
        ids = pa.array(np.arange(t.num_rows) | (f << 32))
        yield from pa.table([ids, t["lang"], t["phrase"]], ["id", "lang", "phrase"]).to_batches()

    rows = cut.select("file", "lang", "phrase").repartitionById(max(1, files), F.col("file")).mapInArrow(put, "id long, lang string, phrase string")
    return scratch.write(rows, "phrase-ids"), files


#: The automata that a worker made last: (folder, file), and by language an automaton.
_MADE: tuple[tuple[str, int], dict] = (("", 0), {})


def automata(folder: str, file: int) -> dict:
    """By language, of one file: an automaton that finds each phrase between blanks, and gives its number in the file."""
    global _MADE
    if _MADE[0] != (folder, file):
        _MADE = ((folder, file), {})
        rows = pa.ipc.open_stream(Store(folder).get(f"phrases-{file}").tobytes()).read_all()
        for k, (lang, phrase) in enumerate(zip(*rows.to_pydict().values(), strict=True)):
            _MADE[1].setdefault(lang, ahocorasick.Automaton(ahocorasick.STORE_INTS)).add_word(f" {phrase} ", k)
        for a in _MADE[1].values():
            a.make_automaton()
    return _MADE[1]


def matched(docs: DataFrame, folder: str, file: int) -> DataFrame:
    """id, n: how often the phrases of one file occur."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for lang, words in by_lang(batches):
            a = automata(folder, file).get(lang)
            if a is None:
                continue
            text = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
            got = np.bincount(np.fromiter(map(itemgetter(1), a.iter(text)), np.int64), minlength=len(counts))
            got[: len(counts)] += counts
            counts = got
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at | (file << 32)), pa.array(counts[at])], ["id", "n"])
        release()

    return in_few_tasks(docs).mapInArrow(run, "id long, n long")


def phrase_counts(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of docs (lang, text): words (lang, word or null, n), those with n >= least and each language's sum; and exact counts
    (lang, phrase, n) of all phrases of 2 to LONGEST words with n >= least."""
    spark = docs.sparkSession
    small_batches(spark)
    words = count_words(docs).filter(F.col("word").isNull() | (F.col("n") >= least))
    words = scratch.write(words, "phrase-words")
    total = words.filter(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0
    folder = shared_folder(spark, "phrases")
    scratch.paths.append(folder)
    frequent = words.filter(F.col("word").isNotNull())
    none = spark.createDataFrame([], "lang string, phrase string, n long")
    if frequent.isEmpty():
        return words, none
    keys = Keys.write(frequent, folder)
    parts = max(1, -(-total // (WORDS_A_CELL << CELL_BITS)))
    pairs = Sketch(f"{folder}/pairs", parts, CELL_BITS).fill(docs, pair_keys(keys), least)
    if not pairs.parts:
        return words, none
    longer = Sketch(f"{folder}/longer", parts, CELL_BITS).fill(docs, longer_keys(keys, pairs), least)
    ids, files = compiled(candidates(docs, keys, pairs, longer), folder, scratch)
    if not files:
        return words, none
    counts = reduce(DataFrame.unionByName, [matched(docs, folder, f) for f in range(files)]).groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return words, scratch.write(counts.join(ids, "id").select("lang", "phrase", "n"), "phrase-counts")


def score_of(a: str, n: str, left: str, right: str) -> Column:
    """1000 a n / (l r), rounded down, in decimals of up to 38 digits."""
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    above = F.lit(1000).cast("decimal(4,0)") * wide(a, 16) * wide(n, 16)
    return F.call_function("div", above.cast("decimal(38,0)"), (wide(left, 18) * wide(right, 18)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT, lang_col: str = "lang", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language whose weakest cut is the strongest.

    A phrase of 2 to 5 words that occurs a >= least times, cut into parts that occur l and r times among n words, scores
    1000 a n / (l r), rounded down; its lowest cut counts, the first of equal ones. Phrases inside a longer one that
    occurs at least inside_percent as often go. Ties by a, then by the phrase's bytes.

    Null languages count as `und`; null, empty and wordless texts hold nothing; repeated rows count each. An empty table
    gives an empty result; other columns play no part. scratch: holds the tables that the result reads.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    words, counts = phrase_counts(docs, least, scratch)
    known = words.filter(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), "n").unionByName(counts)
    totals = words.filter(F.col("word").isNull()).select("lang", F.col("n").alias("all"))  # a row for each language

    parts = F.split("phrase", " ")
    here = counts.select("lang", "phrase", F.col("n").alias("a"), parts.alias("w"))
    sub = here.filter(F.size("w") > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    outer = sub.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    here = here.join(outer, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (100 * F.col("outer") < inside_percent * F.col("a"))).drop("outer")

    cut = here.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    low = cut.withColumn("score", score_of("a", "all", "l", "r")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("all").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    low = low.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deals = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(deals))).orderBy(*order)  # a language may have most phrases
    best = low.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
found AS (SELECT lang, m, w[i:i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) t(m))),
counts AS (SELECT lang, m, array_to_string(p, ' ') AS phrase, count(*) AS n FROM found GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
often AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND n >= 100),
outers AS (SELECT lang, array_to_string(w[s:s + m - 2], ' ') AS phrase, max(a) AS a FROM (SELECT *, unnest([1, 2]) AS s FROM often) GROUP BY ALL),
kept AS (SELECT o.* FROM often o LEFT JOIN outers x ON o.lang = x.lang AND o.phrase = x.phrase WHERE x.a IS NULL OR 100 * x.a < 100 * o.a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.a, k, l.n AS l, r.n AS r, t.n AS n, (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS score
  FROM cuts c JOIN counts l ON c.lang = l.lang AND c.first = l.phrase JOIN counts r ON c.lang = r.lang AND c.rest = r.phrase JOIN totals t ON c.lang = t.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low) WHERE rank <= 2000
"""
