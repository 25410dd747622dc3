"""Secret scans: fixed patterns, and sliding-window Shannon entropy for strings that no pattern names.

Candidate strings are runs of a character class. A window slides over each; the window's entropy follows from counts of
its characters, of which a step changes two. Stretches whose windows are all above the class's threshold are reported.
An allow-list silences the part of a candidate in which it finds a word, not the whole candidate.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, small_batches, table

ASSIGN, ACCESS, HEX, ENTROPY_HEX, ENTROPY_BASE64, ENTROPY_ONE_CASE = "assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_one_case"
#: The order of kinds where spans start at the same place.
KINDS = (ASSIGN, ACCESS, HEX, ENTROPY_HEX, ENTROPY_BASE64, ENTROPY_ONE_CASE)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # leftmost and greedy: the same runs as [0-9a-f]+ of 24 or more


@dataclass(frozen=True)
class CharClass:
    """Runs of `pattern` are candidates; a window of `window` characters counts from `bits` bits of entropy per character.

    mixed: sets of which the window must hold a character each, so that long plain words don't count.
    within: longer runs, outside of which no candidate stands: looked for once for all classes that name them.
    """

    kind: str
    pattern: str
    window: int
    bits: float
    mixed: tuple[frozenset, ...]
    within: str | None = None


_LOWER, _UPPER, _DIGIT = (frozenset(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Keys of digits and letters of one case count by a letter that no hexadecimal number has.
_BEYOND_HEX = (_LOWER | _UPPER) - frozenset("abcdefABCDEF")
CLASSES = (
    CharClass(ENTROPY_HEX, r"[0-9A-Fa-f]{20,}", 20, 3.0, (_LOWER | _UPPER, _DIGIT), _RUN),
    CharClass(ENTROPY_BASE64, _RUN, 20, 3.7, (_LOWER, _UPPER, _DIGIT), _RUN),
    CharClass(ENTROPY_ONE_CASE, r"[a-z0-9]{20,}|[A-Z0-9]{20,}", 20, 3.6, (_BEYOND_HEX, _DIGIT), _RUN),
)
#: What stands in no secret: placeholders, UUIDs, alphabets. A match silences what goes on with it, up to the next of the
#: characters of _PARTS or at most REACH characters away on either side; windows don't extend into that.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|redacted|x{6,}|your[_-]",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789abcdef|abcdefghijkl",
)
REACH = 64
_PARTS = frozenset("/+_=-")


def entropy_windows(s: str, window: int, bits: float, mixed: tuple[frozenset, ...] = ()) -> list[tuple[int, int]]:
    """Stretches (start, end) of s that windows of at least `bits` bits cover. Counts change by two characters a step."""
    if len(s) < window:
        return []
    x_log = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    held = [0] * len(mixed)
    total, out = 0.0, []
    for i, c in enumerate(s):
        if i >= window:
            o = s[i - window]
            n = counts[o]
            total += x_log[n - 1] - x_log[n]
            counts[o] = n - 1
            for k, m in enumerate(mixed):
                held[k] -= o in m
        n = counts.get(c, 0)
        total += x_log[n + 1] - x_log[n]
        counts[c] = n + 1
        for k, m in enumerate(mixed):
            held[k] += c in m
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9 and all(held):
            a, b = i - window + 1, i + 1
            if out and out[-1][1] >= a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def allowed_apart(s: str, allow: list[re.Pattern]) -> list[tuple[int, int]]:
    """The stretches of s that no match of the allow-list silences; all of s where there is none."""
    zones = []
    for p in allow:
        for m in p.finditer(s):
            a, b = m.span()
            while a > 0 and m.start() - a < REACH and s[a - 1] not in _PARTS:
                a -= 1
            while b < len(s) and b - m.end() < REACH and s[b] not in _PARTS:
                b += 1
            zones.append((a, b))
    out, at = [], 0
    for a, b in sorted(zones):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, len(s))] if at < len(s) else out


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(c, re.compile(c.pattern)) for c in classes]
        self.within = {c.within: re.compile(c.within) for c in classes if c.within}
        self.allow = [re.compile(x) for x in allow]
        self.order = {k: i for i, k in enumerate(dict.fromkeys((*KINDS, *(c.kind for c in classes))))}

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), by start and then kind; code points, end exclusive."""
        found = []
        if "=" in text or ":" in text:
            found += [(*m.span(), ASSIGN) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(*m.span(), ACCESS) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [(*m.span(), HEX) for m in _HEX.finditer(text)]
        runs: dict[str | None, list[tuple[int, int]]] = {k: [m.span() for m in p.finditer(text)] for k, p in self.within.items()}
        for cls, pattern in self.classes:
            for lo, hi in runs.get(cls.within, [(0, len(text))]):
                for m in pattern.finditer(text, lo, hi):
                    s = m[0]
                    if any(m_.isdisjoint(s) for m_ in cls.mixed):
                        continue
                    for x, y in allowed_apart(s, self.allow):
                        found += [(m.start() + x + a, m.start() + x + b, cls.kind) for a, b in entropy_windows(s[x:y], cls.window, cls.bits, cls.mixed)]
        return sorted(found, key=lambda x: (x[0], self.order[x[2]], x[1]))


def scan_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row an array of its spans (kind, start, end), in code points, by start and then kind.

    Spans of different kinds may overlap; the same place may be reported by several kinds. Null and empty texts have no
    spans. Repeated rows stay repeated. Long texts are scanned whole; an empty table gives an empty result.
    """

    def make() -> Callable[[list[str]], dict]:
        scan = Scanner(classes, allow)
        return lambda texts: {"spans": [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for t in texts]}

    return map_texts(docs, make, "spans array<struct<kind:string,start:int,end:int>>", id_col, text_col)


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span of every text replaced by `mark`; overlapping spans become one mark.

    length_col, where there is such a column, gets the new length. Null texts stay null. No row is dropped.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        scan = Scanner()
        for batch in batches:
            texts, changed = batch.column(text_col).to_pylist(), False
            for i, text in enumerate(texts):
                if text and (spans := scan(text)):
                    parts, at = [], 0
                    for a, b, _ in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    texts[i], changed = "".join(parts) + text[at:], True
            if changed:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns[text_col] = pa.array(texts, batch.schema.field(text_col).type)
                if length_col in columns:
                    columns[length_col] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length_col).type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> Callable[[list[str]], dict]:
        scan = Scanner()

        def run(texts: list[str]) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in texts:
                spans = scan(text)
                for k in (ASSIGN, ACCESS, HEX):
                    out[f"n_{k}"].append(sum(s[2] == k for s in spans))
                joined = lambda kinds: ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in kinds)  # noqa: B023, E731
                out["base_sha256"].append(hashlib.sha256(joined((ASSIGN, ACCESS, HEX)).encode()).hexdigest())
                out["spans"].append(joined(KINDS))
            return out

        return run

    return map_texts(table(spark, sf_dir, "documents"), make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
