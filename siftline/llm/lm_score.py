"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Tasks count the words and pairs of their texts, and send sorted blocks of counts to the part of the pair's first word;
a part holds a stretch of the hash space, so all pairs with one history meet there already counted by task. The number
of parts follows from the bytes of text. Pairs of a first word that is a large share of all are dealt by both words, and
the sums of such a history are added up in the next step. Parts write sorted arrays into the shared folder; scoring tasks
map these into memory and look up the distinct pairs of a batch. Nothing of the size of the corpus reaches the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, WordHashes, letters_lower, map_texts, mix, part_of, shared_folder, slices, small_batches, table, written

#: Hashes of what stands before the first word and after the last.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Tokens that a task counts before it sends blocks: about 250 MB.
FLUSH_TOKENS = 3_000_000
#: Added to each count by the base score.
ADD = 0.1
#: Bytes of text for each part, and the most parts: beyond that, parts grow.
PART_BYTES, MOST_PARTS = 16 << 20, 50_000
#: Rows, about, in which hot first words are looked for, and how many of them are dealt by both words at most. The list
#: decides only where pairs are counted: any list gives the same model.
HOT_ROWS, MOST_HOT = 2000, 4096
#: Parts of words or pairs that a task keeps mapped, each by one handle. A batch's keys are sorted by part.
OPEN_PARTS = 64
#: Counted words and pairs that a part adds up at a time.
MERGE = 4_000_000


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u + np.uint64(0x9E3779B97F4A7C15) * mix(v))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    n, at, out = data[0], 1 + 10 * data[0], []
    for i in range(n):
        kind, size = struct.unpack_from("<2sQ", data, 1 + 10 * i)
        a = np.frombuffer(data, "<" + kind.decode(), size, at)
        out.append(a)
        at += a.nbytes
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def summed_pairs(u: np.ndarray, v: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(u):
        return u, v, counts.astype(np.int64)
    order = np.lexsort((v, u))
    u, v, counts = u[order], v[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
    return u[first], v[first], np.add.reduceat(counts, first)


def cut_parts(h: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) for sorted hashes."""
    p = part_of(h, parts)
    bounds = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(p[a]), int(a), int(b)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def tokens(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased, as UTF-8."""
    return letters_lower(text).split()


def plan_parts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of parts, and the hashes (sorted) of first words whose pairs would fill a part of their own."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = int(min(MOST_PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))))

    def count(batches):
        hashes, got = WordHashes(), []
        for batch in batches:
            for b in slices(batch):
                ids = hashes([w for t in b.column(0).to_pylist() for w in tokens(t or "")])
                got.append(summed(ids, np.ones(len(ids), np.int64)))
        if got:
            h, n = summed(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            yield pa.RecordBatch.from_arrays([pa.array([None, *h.view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n.tolist()], pa.int64())], ["h", "n"])

    some = docs.select(text.alias("text")).sample(min(1.0, HOT_ROWS / max(1, rows)), seed=7).mapInArrow(count, "h long, n long")
    frequent = some.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(MOST_HOT + 1).collect()
    least = 0.5 / parts * max((r["n"] for r in frequent), default=0)  # the sum of all comes first
    frequent = [r for r in frequent if r["h"] is not None and r["n"] > least]
    return parts, np.unique(np.array([START, *(np.uint64(r["h"] % 2**64) for r in frequent)], np.uint64))


def pair_homes(u: np.ndarray, v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Hashes that tell the parts of pairs: those of their first words, for hot ones those of both."""
    return np.where(is_in(u, hot), pair_hash(u, v), u)


def is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x if len(among) else np.zeros(len(x), bool)


def count_blocks(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """(part, block): counts of words, and of pairs, from each task."""
    small_batches(docs.sparkSession)

    def run(batches):
        hashes, held, size = WordHashes(), [], 0

        def flush():
            ids = np.concatenate(held)  # START w1 .. wn END for each text
            real = ids != START
            words = summed(ids[real], np.ones(int(real.sum()), np.int64))
            follows = np.flatnonzero(real)
            u, v, n = summed_pairs(ids[follows - 1], ids[follows], np.ones(len(follows), np.int64))
            blocks: dict[int, list] = {}
            for p, a, b in cut_parts(words[0], parts):
                blocks[p] = [words[0][a:b], words[1][a:b].astype("<u4")]
            empty = [np.zeros(0, "<u8"), np.zeros(0, "<u4")]
            order = np.argsort(part_of(pair_homes(u, v, hot), parts), kind="stable")
            u, v, n = u[order], v[order], n[order]
            for p, a, b in cut_parts(pair_homes(u, v, hot), parts):
                run_u, run_n = _runs(u[a:b])
                blocks[p] = [*blocks.get(p, empty), run_u, run_n.astype("<u4"), v[a:b], n[a:b].astype("<u4")]
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([pack_arrays(*x) for x in blocks.values()], pa.binary())], ["part", "block"])

        for whole in batches:
            for batch in slices(whole):
                for text in batch.column(0).to_pylist():
                    words = tokens(text or "")
                    ids = np.empty(len(words) + 2, np.uint64)
                    ids[0], ids[-1] = START, END
                    ids[1:-1] = hashes(words)
                    held.append(ids)
                    size += len(ids)
                    if size >= FLUSH_TOKENS:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, block binary")


def _by_part(batches, merge: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each part with its blocks merged, some millions of entries at a time; a task holds one part or few."""
    held: dict[int, list] = {}
    size: dict[int, int] = {}
    for b in batches:
        for p, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = unpack_arrays(block)
            held.setdefault(p, []).append(got)
            size[p] = size.get(p, 0) + max(len(a) for a in got)
            if size[p] >= MERGE:
                held[p], size[p] = [merge(held[p])], 0
    for p, blocks in held.items():
        yield p, merge(blocks)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _pairs_merged(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """words, their counts, first words (as runs of length one), runs, second words, counts of pairs."""
    words, n = summed(_joined([x[0] for x in blocks], "<u8"), _joined([x[1] for x in blocks], "<u4"))
    pairs = [x for x in blocks if len(x) > 2]
    u, v, c = summed_pairs(_joined([np.repeat(x[2], x[3]) for x in pairs], "<u8"), _joined([x[4] for x in pairs], "<u8"), _joined([x[5] for x in pairs], "<u4"))
    return [words, n, u, np.ones(len(u), "<u4"), v, c]


#: What a part learns of its words in the second step: words and counts; second words and their histories; hot first words
#: and their sums (total, n1, n2, n3); counts of counts of the part's own pairs, and how many there are.
_NONE = ["<u8", "<i8", "<u8", "<u4", "<u8", "<i8", "<i8", "<i8", "<i8"]


def write_pairs(blocks: DataFrame, folder: str, parts: int, hot: np.ndarray) -> DataFrame:
    """Writes each part's pairs and histories; (part, block): what it knows of the words of each part."""

    def run(batches):
        store = Store(folder)
        for part, (words, n, u, _, v, c) in _by_part(batches, _pairs_merged):
            hist, length = _runs(u)
            start = np.cumsum(length) - length
            add = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)  # noqa: B023, E731
            sums = [add(c), *(add(c == k if k < 3 else c >= 3) for k in (1, 2, 3))]
            own, spread = ~is_in(hist, hot), is_in(hist, hot)
            key = pair_hash(u, v)
            order = np.argsort(key)
            if len(key):
                ends = {"hist": hist[own], "hist_total": sums[0][own], **{f"hist_n{k}": sums[k][own].astype("<u4") for k in (1, 2, 3)}}
                store.put_all(f"pairs-{part}", {"pair": key[order], **dict(_counts("pair_n", c[order])), **ends})
            rows: dict[int, list[np.ndarray]] = {}
            at = lambda p: rows.setdefault(p, [*(np.zeros(0, t) for t in _NONE), np.zeros(5, "<i8")])  # noqa: B023, E731
            at(part)[:2] = [words, n]
            at(part)[-1] = np.array([*((c == k).sum() for k in (1, 2, 3, 4)), len(c)], "<i8")
            second, m = summed(v, np.ones(len(v), np.int64))
            for p, a, b in cut_parts(second, parts):
                at(p)[2:4] = [second[a:b], m[a:b].astype("<u4")]
            far = [x[spread] for x in (hist, *sums)]
            for p, a, b in cut_parts(far[0], parts):
                at(p)[4:9] = [x[a:b] for x in far]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([pack_arrays(*x) for x in rows.values()], pa.binary())], ["part", "block"])

    return blocks.mapInArrow(run, "part int, block binary")


def _counts(name: str, c: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Counts as single bytes; where the byte is 255, the count is in a list by place."""
    big = np.flatnonzero(c >= 255)
    return [(name, np.minimum(c, 255).astype("u1")), (f"{name}_at", big.astype("<u8")), (f"{name}_big", c[big].astype("<i8"))]


def _words_merged(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    words, n = summed(_joined([x[0] for x in blocks], "<u8"), _joined([x[1] for x in blocks], "<i8"))
    second, m = summed(_joined([x[2] for x in blocks], "<u8"), _joined([x[3] for x in blocks], "<u4"))
    keys = _joined([x[4] for x in blocks], "<u8")
    sums = [summed(keys, _joined([x[k] for x in blocks], "<i8")) for k in (5, 6, 7, 8)]
    return [words, n, second, m, sums[0][0], *(s for _, s in sums), sum((x[9] for x in blocks), np.zeros(5, "<i8"))]


def write_words(blocks: DataFrame, folder: str) -> DataFrame:
    """Writes each part's words with their counts and histories; a row of sums for each part, and one for each hot word."""

    def run(batches):
        store = Store(folder)
        for part, (words, n, second, m, hot, total, n1, n2, n3, of_pairs) in _by_part(batches, _words_merged):
            histories = np.zeros(len(words), np.int64)
            histories[np.searchsorted(words, second)] = m  # each second word was counted as a word
            if len(words):
                store.put_all(f"words-{part}", {"word": words, "word_n": n, "word_m": histories.astype("<u4")})
            sums = [part, int(n.sum()), len(words), int(m.sum()), *of_pairs.tolist(), *(int((histories == k).sum()) for k in (1, 2, 3, 4)), int((histories >= 3).sum())]
            each = [[*sums, None, 0, 0, 0, 0], *([None, *[0] * (len(sums) - 1), h, *x] for h, *x in zip(hot.view(np.int64).tolist(), total.tolist(), n1.tolist(), n2.tolist(), n3.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*each, strict=True)], SUMS + HOT_SUMS)

    return blocks.mapInArrow(run, ", ".join(f"{x} long" for x in SUMS + HOT_SUMS))


SUMS = ["part", "tokens", "words", "pairs", "c1", "c2", "c3", "c4", "own_pairs", "m1", "m2", "m3", "m4", "m3_up"]
HOT_SUMS = ["hot", "hot_total", "hot_n1", "hot_n2", "hot_n3"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D1, D2 and D3+ of modified Kneser-Ney, at 0 nothing; where a count of counts is missing, 1/2, 1 and 3/2."""
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.0), float(k + 1)) for k, x in enumerate(d))])


@dataclass(frozen=True)
class Model:
    """What each worker needs besides the arrays: their folder, the parts that have arrays of words and of pairs, hot first
    words (sorted) with their sums, and sums over the corpus."""

    folder: str
    parts: int
    with_words: frozenset
    with_pairs: frozenset
    hot: np.ndarray
    hot_sums: np.ndarray
    tokens: int
    words: int
    pairs: int
    pair_discounts: tuple
    word_discounts: tuple
    word_spare: float


def train(docs: DataFrame) -> Model:
    """Counts all texts of docs (column text; null: empty)."""
    folder = shared_folder(docs.sparkSession, "ngrams")
    parts, hot = plan_parts(docs)
    blocks = count_blocks(docs, parts, hot).repartitionById(parts, F.col("part"))
    second = write_pairs(blocks, folder, parts, hot).repartitionById(parts, F.col("part"))
    rows = written(write_words(second, folder), "ngram-sums").collect()  # a row for each part and each hot word
    total = {k: sum(r[k] for r in rows) for k in SUMS[1:]}
    d = discounts(*(total[f"m{k}"] for k in (1, 2, 3, 4)))
    spare = d[1] * total["m1"] + d[2] * total["m2"] + d[3] * total["m3_up"]
    sums = sorted((r["hot"] % 2**64, *(r[k] for k in HOT_SUMS[1:])) for r in rows if r["hot"] is not None)
    return Model(
        folder,
        parts,
        frozenset(r["part"] for r in rows if r["words"]),
        frozenset(r["part"] for r in rows if r["own_pairs"]),
        np.array([x[0] for x in sums], np.uint64),
        np.array([x[1:] for x in sums], np.int64).reshape(len(sums), 4),
        total["tokens"],
        total["words"],
        total["pairs"],
        tuple(discounts(*(total[f"c{k}"] for k in (1, 2, 3, 4)))),
        tuple(d),
        float(spare),
    )


class Scorer:
    """Looks up what a batch needs in mapped arrays, of a bounded number of parts at a time."""

    def __init__(self, model: Model):
        self.m, self.store = model, Store(model.folder)
        self.open: dict[str, dict[str, np.ndarray]] = {}
        self.hashes = WordHashes()

    def _array(self, name: str, part: int) -> np.ndarray | None:
        """None where training met nothing of the kind; an array that was written and can't be read is an error."""
        if part not in (self.m.with_words if name.startswith("word") else self.m.with_pairs):
            return None
        key = f"{'words' if name.startswith('word') else 'pairs'}-{part}"
        if key not in self.open:
            if len(self.open) >= OPEN_PARTS:
                self.open.clear()
            self.open[key] = self.store.get_all(key)
        return self.open[key][name]

    def _find(self, keys: np.ndarray, home: np.ndarray, index: str, *values: str) -> list[np.ndarray]:
        """For distinct keys and the hashes that tell their parts: the values, 0 where the key isn't there."""
        out = [np.zeros(len(keys), np.int64) for _ in values]
        part = part_of(home, self.m.parts)
        order = np.lexsort((keys, part))
        p, lengths = _runs(part[order])
        at = 0
        for q, n in zip(p.tolist(), lengths.tolist(), strict=True):
            rows, at = order[at : at + n], at + n
            a = self._array(index, q)
            if a is None or not len(a):
                continue
            pos = np.minimum(np.searchsorted(a, keys[rows]), len(a) - 1)
            hit = a[pos] == keys[rows]
            rows, pos = rows[hit], pos[hit]
            for o, name in zip(out, values, strict=True):
                got = self._array(name, q)[pos].astype(np.int64)
                if name == "pair_n" and len(big := np.flatnonzero(got == 255)):
                    got[big] = self._array("pair_n_big", q)[np.searchsorted(self._array("pair_n_at", q), pos[big].astype(np.uint64))]
                o[rows] = got
        return out

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        m = self.m
        lists = [tokens(t) for t in texts]
        n = np.array([len(x) + 1 for x in lists], np.int64)
        ids = np.empty(int(n.sum()), np.uint64)
        last = np.cumsum(n) - 1
        inner = np.ones(len(ids), bool)
        inner[last] = False
        ids[last] = END
        ids[inner] = self.hashes([w for x in lists for w in x])
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[last - n + 1] = START
        row = np.repeat(np.arange(len(n)), n)

        words, at = np.unique(ids, return_inverse=True)
        c, h = self._find(words, words, "word", "word_n", "word_m")
        d = np.array(m.word_discounts)
        if m.pairs:
            p_word = (np.maximum(h - d[np.minimum(h, 3)], 0) + m.word_spare / (m.words + 1)) / m.pairs
        else:
            p_word = np.full(len(words), 1 / (m.words + 1))
        base = np.log10((c + ADD) / (m.tokens + ADD * (m.words + 1)))

        hist, hist_at = np.unique(before, return_inverse=True)
        total, n1, n2, n3 = self._find(hist, hist, "hist", "hist_total", "hist_n1", "hist_n2", "hist_n3")
        if len(at_hot := np.flatnonzero(is_in(hist, m.hot))):
            for a, x in zip((total, n1, n2, n3), m.hot_sums[np.searchsorted(m.hot, hist[at_hot])].T, strict=True):
                a[at_hot] = x
        dp = np.array(m.pair_discounts)
        spare = np.where(total > 0, (dp[1] * n1 + dp[2] * n2 + dp[3] * n3) / np.maximum(total, 1), 1.0)
        keys, first, pair_at = np.unique(pair_hash(before, ids), return_index=True, return_inverse=True)
        (cp,) = self._find(keys, pair_homes(before[first], ids[first], m.hot), "pair", "pair_n")
        t = total[hist_at[first]]
        own = np.where(t > 0, np.maximum(cp - dp[np.minimum(cp, 3)], 0) / np.maximum(t, 1), 0.0)
        log_p = np.log10(own + spare[hist_at[first]] * p_word[at[first]])
        by_row = lambda x: np.bincount(row, x, len(n))
        return {"n_tokens": n, "n_known": by_row((c > 0)[at]).astype(np.int64), "base_score": by_row(base[at]), "score": by_row(log_p[pair_at])}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score, score (log10 probability) and perplexity of each whole text.

    Null and empty texts are their end token alone. Repeated rows stay repeated. A word that training hasn't met shares
    the probability of one unknown word. A model of no texts gives every text the probability 1. An empty table gives an
    empty result.
    """

    def make() -> Callable[[list[str]], dict]:
        scorer = Scorer(model)

        def run(texts: list[str]) -> dict:
            out = scorer(texts)
            out["train_tokens"] = np.full(len(texts), model.tokens)
            out["perplexity"] = 10.0 ** (-out["score"] / out["n_tokens"])
            return out

        return run

    return map_texts(docs, make, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", id_col, text_col)


def held_out(id_col, folds: int):
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"), 10)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
