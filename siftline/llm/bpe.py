"""BPE encoding and decoding with a byte-level vocabulary.

Text is split into pieces as the vocabulary's pre-tokenizer splits it. A long piece has no split, and is encoded as a
tree: its halves (of very long ones, more parts) in parallel, then at each join a window that grows until its tokens agree
with those on both sides. Two tokens that stand side by side in the encoding of some text are a valid
pair, and a sequence of valid pairs is the encoding of its text; so agreement on one token at either end is enough.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import gather, map_texts, table

#: Characters of a piece beyond which it is encoded as a tree, and bytes of the largest leaf of that tree.
LONG, LEAF = 16, 1024
#: Tokens on either side of a join that the first window holds.
WINDOW = 4
#: Parts of one text encoded at a time.
THREADS = 2
#: The pre-tokenizer of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space, as PIECES understands it.
SPACES = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, the rest from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes texts; one in each task.

    The vocabulary's ids follow the order of its merges (checked), so ids serve as ranks for a core that works on bytes.
    """

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letter = {c: b for b, c in enumerate(byte_letters())}
        vocab, added = data["model"]["vocab"], {t["content"]: t["id"] for t in data["added_tokens"]}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in data["model"]["merges"]]
        if merged != sorted(merged) or data["normalizer"] or data["pre_tokenizer"] != BYTE_LEVEL:
            raise ValueError(f"{path} is no byte-level vocabulary in the order of its merges")
        tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        ranks = {}
        for t, i in vocab.items():
            if t not in added:
                tokens[i] = bytes(letter[c] for c in t)
                ranks[tokens[i]] = i
        for t, i in added.items():
            tokens[i] = t.encode()
        self.tokens, self.special = tokens, added
        self.core = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.one_piece = self.core._core_bpe.encode_single_piece
        self.long, self.leaf, self.window = long, leaf, window
        # Stretches that may hold a piece of more than `long` characters: such words and runs of white space, the character
        # before them included. They begin and end where pieces do, so the text between is encoded as it is.
        self.stretches = re.compile(rf"[{SPACES}](?:[^{SPACES}]{{{long + 1},}}|[{SPACES}]{{{long},}}(?:(?=[{SPACES}][^{SPACES}])|\Z))").finditer
        self.tree_pieces = 0
        self.special_split = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.pool = None

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; tree_pieces counts the pieces encoded as trees."""
        runs = self.special_split.split(text) if self.special and any(s in text for s in self.special) else [text]
        if len(runs) == 1:
            return self._encode_run(text)
        return [i for run in runs for i in ([self.special[run]] if run in self.special else self._encode_run(run))]

    def _encode_run(self, run: str) -> list[int]:
        out: list[int] = []
        end = 0
        for m in self.stretches(" " + run):  # so that the first word has a blank before it, too
            start, stop = max(m.start() - 1, 0), m.end() - 1
            pieces = regex.findall(PIECES, run[start:stop])
            if max(map(len, pieces), default=0) <= self.long:
                continue
            out += self.core.encode_ordinary(run[end:start])
            for p in pieces:
                out += (self.encode_long if len(p) > self.long else self.one_piece)(p.encode("utf-8", "replace"))
            end = stop
        return out + self.core.encode_ordinary(run[end:])

    def encode_parts(self, parts: list[bytes]) -> list[list[int]]:
        """Each part as a piece of its own, in parallel: the core works without the interpreter's lock."""
        if len(parts) < 4:
            return [self.one_piece(p) for p in parts]
        self.pool = self.pool or ThreadPoolExecutor(THREADS)
        return list(self.pool.map(self.one_piece, parts, chunksize=-(-len(parts) // (4 * THREADS))))

    def encode_long(self, piece: bytes) -> list[int]:
        """Tree concatenation."""
        self.tree_pieces += 1
        leaf = min(self.leaf, -(-len(piece) // 2))
        level = self.encode_parts([piece[i : i + leaf] for i in range(0, len(piece), leaf)])
        while len(level) > 1:
            level = self._join_level(level)
        return level[0]

    def _join_level(self, level: list[list[int]]) -> list[list[int]]:
        """Joins neighbours two by two; all windows of the level are encoded together, then those that must grow."""
        pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        out: list[list[int]] = [[] for _ in pairs]
        width = dict.fromkeys(range(len(pairs)), self.window)
        while width:
            windows, at = [], []
            for k, w in width.items():
                left, right = pairs[k]
                i, j = max(0, len(left) - w), min(len(right), w)
                windows.append(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
                at.append((k, i, j))
            for (k, i, j), ids in zip(at, self.encode_parts(windows), strict=True):
                left, right = pairs[k]
                if (i == 0 or ids[0] == left[i]) and (j == len(right) or ids[-1] == right[j - 1]):
                    out[k] = left[:i] + ids + right[j:]
                    del width[k]
                else:
                    width[k] *= 2
        return [*out, level[-1]] if len(level) % 2 else out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, end to end."""
        return self.token_bytes[gather(self.token_start[ids], self.token_len[ids])].tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, path: str, long: int = LONG, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids: the token ids of each whole text, as the tokenizers library gives them without added special tokens.

    Null and empty texts have no ids. Repeated rows stay repeated. Strings of special tokens in a text become these
    tokens. An empty table gives an empty result.
    """

    def make() -> Callable[[list[str]], dict]:
        codec = Codec(path, long, leaf)
        return lambda texts: {"ids": pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32()))}

    return map_texts(docs, make, "ids array<int>", id_col, text_col)


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """text: what the ids stand for; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""
    src = rows.select(rows[id_col].alias("__id"), rows[ids_col].cast("array<int>").alias("ids"))
    key = id_col if id_col != "text" else "text_key"

    def run(batches):
        codec = Codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return src.mapInArrow(run, f"`{key}` {src.schema['__id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()

    def make() -> Callable[[list[str]], dict]:
        codec = Codec(path)
        numerals = [str(i) for i in range(len(codec.tokens))].__getitem__

        def run(texts: list[str]) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "n_tree_pieces")}
            for text in texts:
                before = codec.tree_pieces
                ids = codec.encode(text)
                out["n_tree_pieces"].append(codec.tree_pieces - before)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(numerals, ids)).encode()).hexdigest())
                data = codec.decode_bytes(np.array(ids, np.int64))
                out["decoded_sha256"].append(hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest())
            return out

        return run

    return map_texts(table(spark, sf_dir, "documents"), make, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_tree_pieces long")
