"""Best-fit packing of documents into sequences: best-two-fit over a histogram of lengths.

Only lengths matter to a packing, and there are at most `size` different ones. So the plan is made from counts by length,
whatever the number of documents: sequences are filled greedily with the longest piece that fits; then the smallest piece
of a sequence with a gap gives way to two unpacked pieces that fill the gap more tightly. What is decided for one
sequence holds for as many as the counts allow. Pieces get their places by their rank among those of their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary
from .common import gather, slices, small_batches, table, written

SIZE = 4096
#: Distinct words that a worker keeps, and the characters of the longest: about 250 bytes each, so 100 MB.
KNOWN_WORDS, KNOWN_CHARS = 400_000, 32
END_ID = 1
WORDS = "word_bpe_49k.json"
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a word; the byte never occurs in UTF-8.
_END = b"\xff"
#: Characters beyond those whose classes, cases and compositions are alike in all Unicode versions in use.
_FAR = re.compile("[^\x00-\u052f\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]").search


class WordCodec:
    """Ids of texts by a vocabulary of lower-cased words with word ends.

    No piece holds a space or a line feed, so texts are cut there, and what lies between is encoded once per worker.
    """

    def __init__(self, path: str, entries: int = KNOWN_WORDS):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        suffix = data["model"]["end_of_word_suffix"]
        if data["normalizer"] != {"type": "Sequence", "normalizers": _NORMALIZER} or data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _PIECES:
            raise ValueError(f"{path} normalises or splits in a way that isn't known here")
        letter = {c: b for b, c in enumerate(byte_letters())}
        vocab, added = data["model"]["vocab"], {t["content"]: t["id"] for t in data["added_tokens"]}

        def raw(token: str) -> bytes:
            return bytes(letter[c] for c in token[: -len(suffix)]) + _END if token.endswith(suffix) else bytes(letter[c] for c in token)

        single = [bytes([b]) for b in range(256)]
        order = [*single, *(x + _END for x in single if x != _END), *(raw("".join(m if isinstance(m, list) else m.split(" "))) for m in data["model"]["merges"])]
        ranks: dict[bytes, int] = {}
        for x in order:
            ranks.setdefault(x, len(ranks))
        by_raw = {raw(t): i for t, i in vocab.items() if t not in added}
        self.id_of_rank = np.array([by_raw.get(x, -1) for x in ranks], np.int64)
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.one_piece = self.core._core_bpe.encode_single_piece
        self.pieces = regex.compile(_PIECES).findall
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = added
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.entries = entries
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.late: list[str] = []
        self.flat, self.start, self.length = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _keep(self, words: set[str]) -> list[str]:
        """Which of these new words stay known; those met last are forgotten where there is no room for more."""
        short = [w for w in words if len(w) <= KNOWN_CHARS]
        room = self.entries - len(self.known)
        if len(short) <= room and len(self.known) > 3 * self.entries // 4:
            self.late += short
        return short if len(short) <= room else []

    def _make_room(self, more: int) -> None:
        """Forgets the words met last, where more don't fit: those met first are the frequent ones."""
        if len(self.known) + more > self.entries and self.late:
            self._forget(self.late)
            self.late = []

    def _forget(self, last: list[str]) -> None:
        for w in last:
            del self.known[w]
        n = len(self.known)
        self.start, self.length = self.start[:n], self.length[:n]
        self.flat = self.flat[: int(self.start[-1] + self.length[-1])]

    def _learn(self, words: list[str]) -> None:
        """Ids of words as they stand; those with characters that Unicode's versions may class differently go to the library."""
        far = [w for w in words if _FAR(w)]
        ids = {w: e.ids for w, e in zip(far, self.library.encode_batch_fast(far, add_special_tokens=False), strict=True)}
        parts, lengths, ranks = [], [], []

        def flush() -> None:
            if ranks:
                parts.append(self.id_of_rank[np.array(ranks, np.int64)])
                ranks.clear()

        for w in words:
            self.known[w] = len(self.known)
            if w in ids:
                flush()
                parts.append(np.array(ids[w], np.int64))
                lengths.append(len(ids[w]))
                continue
            at = len(ranks)
            for p in self.pieces(w):
                ranks += self.one_piece(p.encode() + _END)
            lengths.append(len(ranks) - at)
        flush()
        more = np.array(lengths, np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(more) - more])
        self.length = np.concatenate([self.length, more])
        self.flat = np.concatenate([self.flat, *parts])

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # such texts are composed, and hold no far characters
        except UnicodeEncodeError:
            if _FAR(text):
                return [w if _FAR(w) else " ".join(self._words(w)) for w in text.replace("\n", " ").split(" ")]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().replace("\n", " ").split(" ")

    def _plain(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts given as words: all are looked up, then what is missing is learned at once; what isn't kept goes again."""
        self._make_room(self.entries // 8)  # before the look-up, whose places then stay
        at = [np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words)) for words in texts]
        gaps = [(i, np.flatnonzero(k < 0).tolist()) for i, k in enumerate(at) if k.min() < 0]
        passing: list[str] = []
        if gaps:
            new = {texts[i][j] for i, missing in gaps for j in missing}
            kept = self._keep(new)
            passing = list(new.difference(kept))
            self._learn(kept + passing)  # in this order, so that the last can be forgotten
            for i, missing in gaps:
                words = texts[i]
                at[i][missing] = [self.known[words[j]] for j in missing]
        out = [self.flat[gather(self.start[k], self.length[k])] for k in at]
        if passing:
            self._forget(passing)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        mixed = {i for i, t in enumerate(texts) if "<|" in t and self.special_split.search(t)}
        out = self._plain([self._words("" if i in mixed else t) for i, t in enumerate(texts)])
        for i in mixed:
            runs = self.special_split.split(texts[i])
            parts = self._plain([self._words("" if r in self.special else r) for r in runs])
            out[i] = np.concatenate([np.array([self.special[r]], np.int64) if r in self.special else p for r, p in zip(runs, parts, strict=True)])
        return out


def plan_packing(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence's pieces, number of such sequences): counts[n] pieces of length n, 0 < n <= size."""
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    plan: list[tuple[list[int], int]] = []
    while True:
        lengths = np.flatnonzero(counts)
        if not len(lengths):
            return plan
        used: dict[int, int] = {}
        left = lambda n: int(counts[n]) - used.get(int(n), 0)  # noqa: B023, E731
        parts, gap = [int(lengths[-1])], size - int(lengths[-1])
        used[parts[0]] = 1
        while gap:  # the longest that fits, as often as it fits
            i = int(np.searchsorted(lengths, gap, "right")) - 1
            while i >= 0 and not left(lengths[i]):
                i -= 1
            if i < 0:
                break
            n = int(lengths[i])
            k = min(gap // n, left(n))
            parts += [n] * k
            used[n] = used.get(n, 0) + k
            gap -= n * k
        while gap and len(parts) > 1:
            small = parts[-1]
            if not (pair := _two(lengths, counts, used, gap + small, small)):
                break
            used[small] -= 1
            for n in pair:
                used[n] = used.get(n, 0) + 1
            gap += small - sum(pair)
            parts = sorted([*parts[:-1], *pair], reverse=True)
        many = min(int(counts[n]) // k for n, k in used.items() if k)
        for n, k in used.items():
            counts[n] -= k * many
        plan.append((parts, many))


def _two(lengths: np.ndarray, counts: np.ndarray, used: dict[int, int], room: int, least: int) -> tuple[int, int] | None:
    """Two unpacked pieces with the largest sum up to `room`, if that is above `least`."""
    spare = counts[lengths]
    for n, k in used.items():
        spare[np.searchsorted(lengths, n)] -= k
    a = lengths[(spare > 0) & (lengths < room)]
    if not len(a):
        return None
    twice = np.zeros(room + 1, bool)
    twice[lengths[(spare > 1) & (lengths <= room)]] = True
    at = np.searchsorted(a, room - a, "right") - 1
    same = (at >= 0) & (a[at] == a) & ~twice[a]  # the same piece can't be taken twice
    at = np.where(same, at - 1, at)
    sums = np.where(at >= 0, a + a[at], -1)
    i = int(np.argmax(sums))
    return (int(a[i]), int(a[at[i]])) if sums[i] > least else None


def places(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length << 50 | first rank), the first rank's sequence and the offset there, sorted; each holds for the ranks up to the next."""
    keys, seqs, offsets = [], [], []
    taken: dict[int, int] = {}
    seq = 0
    for parts, many in plan:
        offset = 0
        for n in parts:
            keys.append(n << 50 | taken.get(n, 0))
            seqs.append(seq)
            offsets.append(offset)
            taken[n] = taken.get(n, 0) + many
            offset += n
        seq += many
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(seqs, np.int64)[order], np.array(offsets, np.int64)[order]


def piece_table(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and part and rank: the task, and the place among its pieces of this length."""
    small_batches(docs.sparkSession)
    src = docs.select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        codec, part = None, TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for whole in batches:
            for batch in slices(whole):
                codec = codec or _codec(path)
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, ids in enumerate(codec.encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids = np.append(ids, end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), size)):
                        cut = ids[at : at + size]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        rank.append(int(seen[len(cut)]))
                        seen[len(cut)] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int64()), pa.array(rank, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return src.mapInArrow(run, f"doc_id {src.schema['__id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, rank long")


_codecs: dict[str, WordCodec] = {}


def _codec(path: str) -> WordCodec:
    """Stays with the worker, so that its next task finds the words known."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset: no sequence holds more than `size` tokens, none has a hole.

    A null or empty text is a piece that holds end_id alone. A document of more than `size` tokens is cut into pieces of
    `size`, the last one shorter. Repeated rows are packed once each; equal lengths are interchangeable, and which of
    them goes where follows the order of tasks. An empty table gives an empty result. The id comes back as doc_id.
    """
    pieces = written(piece_table(docs, path, size, end_id, id_col, text_col), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    keys, seqs, offsets = places(plan_packing(counts, size))
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def assign(batches):
        for b in batches:
            n, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(keys, (n << 50) | rank, "right") - 1
            seq = seqs[at] + (((n << 50) | rank) - keys[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offsets[at])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(assign, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(WORDS))
