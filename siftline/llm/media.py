"""Media columns: bytes kept as lossless WebP, and read back as pixel arrays.

A payload is a picture of 64 pixels a row, three bytes a pixel. It is stored in strips of 64 rows, a WebP file each, end to end:
no strip grows with its text, any of them can be read alone, and a batch's strips are encoded and decoded in step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


from . import webp
from .common import small_batches, table

ROW_PIXELS, STRIP_ROWS = 64, 64
ROW_BYTES = 3 * ROW_PIXELS
#: Payload bytes that are encoded, and decoded, together, about; a larger payload goes in several turns. Encoding takes
#: about 90 bytes of memory for each, decoding 20.
ENCODE_TOGETHER, DECODE_TOGETHER = 2 << 20, 6 << 20


def padded(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def to_files(payloads: list[bytes], options: webp.Options = webp.Options()) -> list[bytes]:
    """The stored form of payloads, each a positive multiple of a row long."""
    strips: list[np.ndarray] = []
    owner: list[int] = []
    parts: list[list[bytes]] = [[] for _ in payloads]
    size = 0

    def flush():
        for i, f in zip(owner, webp.encode(strips, options), strict=True):
            parts[i].append(f)
        strips.clear()
        owner.clear()

    step = ROW_BYTES * STRIP_ROWS
    for i, data in enumerate(payloads):
        x = np.frombuffer(data, np.uint8)
        for at in range(0, len(x), step):
            rgb = x[at : at + step].reshape(-1, ROW_PIXELS, 3)
            strips.append(np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], axis=2))
            owner.append(i)
            size += rgb.size
            if size >= ENCODE_TOGETHER:
                flush()
                size = 0
    flush()
    return [b"".join(p) for p in parts]


def split_files(media: bytes) -> list[bytes]:
    """The WebP files that stand end to end; each tells its size."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or at + 8 > len(media):
            raise webp.WebPError("no WebP container")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:end])
        at = end
    return out


def from_files(media: list[bytes]) -> list[np.ndarray]:
    """(rows, pixels, 3) of each stored form."""
    files: list[bytes] = []
    owner: list[int] = []
    parts: list[list[np.ndarray]] = [[] for _ in media]
    size = 0

    def flush():
        for i, x in zip(owner, webp.decode(files), strict=True):
            parts[i].append(x[..., :3])
        files.clear()
        owner.clear()

    for i, data in enumerate(media):
        for f in split_files(data):
            files.append(f)
            owner.append(i)
            width, height = _sides(f)
            size += 3 * width * height
            if size >= DECODE_TOGETHER:
                flush()
                size = 0
    flush()
    return [np.concatenate(p) if p else np.zeros((0, ROW_PIXELS, 3), np.uint8) for p in parts]


def _sides(file: bytes) -> tuple[int, int]:
    chunk = webp.container_chunk(file)
    word = int.from_bytes(chunk[1:5], "little")
    return (word & 0x3FFF) + 1, (word >> 14 & 0x3FFF) + 1


def block_hashes(images: list[np.ndarray]) -> list[str]:
    """64 bits as hex: which of 8 x 8 blocks are brighter than the picture; rows of a block may be none or more than one."""
    rows = np.array([len(x) for x in images])
    bright = np.concatenate([x.reshape(len(x), 8, -1).sum(axis=2, dtype=np.int64) for x in images])
    start = np.cumsum(rows) - rows
    total = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(bright, axis=0)])
    edge = rows[:, None] * np.arange(9) // 8
    sums = total[start[:, None] + edge[:, 1:]] - total[start[:, None] + edge[:, :-1]]
    area = edge[:, 1:] - edge[:, :-1]
    whole = sums.sum(axis=(1, 2))
    above = sums * 8 * rows[:, None, None] > whole[:, None, None] * area[:, :, None]
    packed = np.packbits(above.reshape(len(images), 64), axis=1)
    return [x.tobytes().hex() for x in packed]


def _gathered(batches, column: str, limit: int):
    """Batches joined until they hold `limit` bytes in a column."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: webp.Options = webp.Options()) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media (its padded payload's stored form). Null texts are empty ones.

    Repeated rows stay repeated; equal texts have equal media. An empty text is one row of spaces. Texts of any length are
    stored whole. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for t in _gathered(batches, "text", ENCODE_TOGETHER):
            data = [(x or "").encode("utf-8", "replace") for x in t.column("text").to_pylist()]
            media = to_files([padded(x) for x in data], options)
            for at in range(0, len(data), 1000):
                to = at + 1000
                yield pa.RecordBatch.from_arrays([t.column("doc_id").slice(at, 1000).combine_chunks(), pa.array([len(x) for x in data[at:to]], pa.int64()), pa.array(media[at:to], pa.binary())], ["doc_id", "n_bytes", "media"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, height, width and pixels (red, green, blue by rows) of stored forms; null where the media is null or empty.

    Bytes that aren't lossless WebP end the job with an error that says so.
    """
    small_batches(media.sparkSession)
    src = media.select(media[id_col].alias("doc_id"), media[media_col].alias("media"))

    def run(batches):
        for t in _gathered(batches, "media", DECODE_TOGETHER // 2):
            got = from_files([x or b"" for x in t.column("media").to_pylist()])
            for at in range(0, len(got), 1000):
                some = got[at : at + 1000]
                yield pa.RecordBatch.from_arrays(
                    [t.column("doc_id").slice(at, 1000).combine_chunks(), *(pa.array([x.shape[k] if len(x) else None for x in some], pa.int32()) for k in (0, 1)), pa.array([x.tobytes() if len(x) else None for x in some], pa.binary())],
                    ["doc_id", "height", "width", "pixels"],
                )

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, height int, width int, pixels binary")


def digests(stored: DataFrame) -> DataFrame:
    """Reads media back and describes it: what the registered query returns. stored: doc_id, n_bytes, media."""

    def run(batches):
        for t in _gathered(batches, "media", DECODE_TOGETHER // 2):
            media = t.column("media").to_pylist()
            images = from_files(media)
            payload = [x.tobytes() for x in images]
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("doc_id").combine_chunks(),
                    t.column("n_bytes").combine_chunks(),
                    pa.array([len(p) for p in payload], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
                    pa.array([zlib.crc32(p[-16:]) for p in payload], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(block_hashes(images)),
                ],
                NAMES,
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_media(table(spark, sf_dir, "documents")))
