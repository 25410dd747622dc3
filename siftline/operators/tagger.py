"""Taggers: name spans in lines, from a model that workers load, or from a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = "file string, line_num int, col_start int, col_end int, entity_type string, text string, score float"
#: A tag, or a line that a model failed on, with what it said: such a row has no type.
TAGS_OR_ERRORS = TAGS + ", error string"
BATCH_LINES = 32
MAX_TOKENS = 512
# The labels of a nine-class tagger, the types they stand for, and its score.
LABELS = ("O", "B-MISC", "I-MISC", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC")
TYPES = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION"}
TAG_SCORE = 0.85


def decode_labels(labels: Iterable[str]) -> list[tuple[int, int, str]]:
    """(first token, last token, kind) of B/I and L/U labels. I without a span of its kind starts one."""
    out: list[tuple[int, int, str]] = []
    span: tuple[int, int, str] | None = None
    for i, label in enumerate(labels):
        prefix, kind = (label[0], label[2:]) if label[1:2] == "-" and label[0] in "BILU" else ("O", "")
        goes_on = prefix in "IL" and span is not None and span[2] == kind
        if span and not goes_on:
            out.append(span)
            span = None
        if goes_on:
            span = (span[0], i, kind)
        elif prefix != "O":
            span = (i, i, kind)
        if prefix in "LU" and span:
            out.append(span)
            span = None
    return [*out, span] if span else out


def spans_to_tags(line: str, spans: Iterable[tuple[int, int, str]], offsets: list[tuple[int, int]]) -> list[tuple[int, int, str, str, float]]:
    """(from, to, type, text, score), in bytes of the line. offsets: bytes of tokens in the line without its indent."""
    body = line.strip().encode()
    indent = len(line.encode()) - len(line.lstrip().encode())
    out = []
    for a, b, kind in spans:
        if kind not in TYPES or a >= len(offsets) or b >= len(offsets):
            continue
        lo, hi = offsets[a][0], offsets[b][1]
        text = body[lo:hi].decode("utf-8", "replace")
        if lo < hi <= len(body) and text.strip() and hi - lo >= 2:
            out.append((indent + lo, indent + hi, TYPES[kind], text, TAG_SCORE))
    return out


def _tagged(predict: Callable[[list[str]], list], rows: list[dict]) -> Iterator[tuple[dict, list, str | None]]:
    """(row, its tags, error): a batch that fails is halved until the line that it fails on stands alone."""
    try:
        yield from ((r, tags, None) for r, tags in zip(rows, predict([r["line_content"] for r in rows]), strict=True))
    except Exception as e:  # noqa: BLE001  whatever a model raises mustn't end the scan
        if len(rows) == 1:
            yield rows[0], [], f"{type(e).__name__}: {e}"[:500]
        else:
            yield from _tagged(predict, rows[: len(rows) // 2])
            yield from _tagged(predict, rows[len(rows) // 2 :])


def model_tagger(load: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str, str, float]]]]], batch: int = BATCH_LINES, least: int = 3, most: int | None = None, threshold: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """A tagger from a function of lines that `load` makes once in each worker's task, with its model.

    Lines of fewer than `least` or more than `most` bytes (without indent) have no tags. Lines go into batches by length, so
    that little is padded. A line on which the model fails comes back as a row with `error`; those batched with it keep
    their tags.
    """

    def tag(lines: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = None
            for b in batches:
                rows = [r for r in b.to_pylist() if r["line_content"] and len(r["line_content"].strip().encode()) >= least and (most is None or len(r["line_content"].encode()) <= most)]
                rows.sort(key=lambda r: len(r["line_content"]))
                out = []
                for at in range(0, len(rows), batch):
                    predict = predict or load()
                    for r, tags, error in _tagged(predict, rows[at : at + batch]):
                        out += [(r["file"], r["line_num"], a, z, kind, text, score, None) for a, z, kind, text, score in tags if score >= threshold]
                        if error:
                            out.append((r["file"], r["line_num"], None, None, None, None, None, error))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in TAGS_OR_ERRORS.split(", ")])

        return lines.mapInArrow(run, TAGS_OR_ERRORS)

    return tag


# What a zero-shot tagger is asked for, and the types that the answers stand for.
ZERO_SHOT = {
    "person": "PERSON",
    "organization": "ORGANIZATION",
    "location": "LOCATION",
    "phone number": "PHONE_NUMBER",
    "email": "EMAIL_ADDRESS",
    "social security number": "US_SSN",
    "credit card number": "CREDIT_CARD",
    "ip address": "IP_ADDRESS",
    "passport number": "US_PASSPORT",
    "driver license": "US_DRIVER_LICENSE",
    "medical license number": "MEDICAL_LICENSE",
}
ZERO_SHOT_THRESHOLD, LONGEST_LINE = 0.5, 2000


def zero_shot_tagger(load: Callable[[], Callable[[list[str], list[str]], list[list[tuple[int, int, str, float]]]]], types: dict[str, str] = ZERO_SHOT, threshold: float = ZERO_SHOT_THRESHOLD) -> Callable[[DataFrame], DataFrame]:
    """A tagger from a model that takes whole lines and labels, and gives (from, to, label, probability) in bytes of the line."""

    def loaded():
        model = load()

        def predict(lines: list[str]):
            out = []
            for line, spans in zip(lines, model(lines, list(types)), strict=True):
                data = line.encode()
                out.append([(a, b, types[label], data[a:b].decode("utf-8", "replace"), p) for a, b, label, p in spans if label in types and 0 <= a < b <= len(data)])
            return out

        return predict

    return model_tagger(loaded, most=LONGEST_LINE, threshold=threshold)


def onnx_tagger(model_path: str, tokenizer_path: str, labels: tuple[str, ...] = LABELS) -> Callable[[DataFrame], DataFrame]:
    """A tagger from an exported token classifier; both paths must be readable on every worker."""

    def load():
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        session, tok = onnxruntime.InferenceSession(model_path), Tokenizer.from_file(tokenizer_path)
        names = [i.name for i in session.get_inputs()]

        def predict(lines: list[str]):
            bodies = [x.strip() for x in lines]
            encoded = tok.encode_batch(bodies)
            use = [i for i, e in enumerate(encoded) if len(e.ids) <= MAX_TOKENS]
            out: list[list] = [[] for _ in lines]
            if not use:
                return out
            size = max(len(encoded[i].ids) for i in use)
            feed = {"input_ids": np.zeros((len(use), size), np.int64), "attention_mask": np.zeros((len(use), size), np.int64), "token_type_ids": np.zeros((len(use), size), np.int64)}
            for k, i in enumerate(use):
                feed["input_ids"][k, : len(encoded[i].ids)] = encoded[i].ids
                feed["attention_mask"][k, : len(encoded[i].ids)] = 1
            best = session.run(None, {n: feed[n] for n in names})[0].argmax(axis=2)
            for k, i in enumerate(use):
                e = encoded[i]
                places = [len(bodies[i][:a].encode()) for a, _ in e.offsets], [len(bodies[i][:b].encode()) for _, b in e.offsets]
                named = [labels[c] if c < len(labels) else "O" for c in best[k, : len(e.ids)]]
                out[i] = spans_to_tags(lines[i], decode_labels(named), list(zip(*places, strict=True)))
            return out

        return predict

    return model_tagger(load)


def table_tagger(tags: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Tags that are at hand as a table, for the lines asked for."""
    return lambda lines: tags.join(lines.select("file", "line_num").distinct(), ["file", "line_num"], "left_semi").select(*(F.col(x.split()[0]) for x in TAGS.split(", ")))
