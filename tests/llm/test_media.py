import hashlib
import random
import zlib

import numpy as np
from siftline.llm import media


def texts():
    rng = random.Random(9)
    out = ["", None, "a", "x" * 191, "x" * 192, "x" * 193, "line of text\n" * 3000, "é日😀" * 500]
    return [*out, *("".join(rng.choices("abc def\n", k=rng.randint(1, 4000))) for _ in range(40)), "".join(rng.choices("abcdefghij klm", k=200_000)), "a"]


def test_query(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        data = (t or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        stored = media.to_files([payload])[0]
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert tuple(got[0])[1:] == tuple(got[1])[1:] and tuple(got[2])[1:] == tuple(got[len(rows) - 1])[1:]


def test_small_turns_give_the_same(monkeypatch):
    data = [media.padded((t or "").encode()) for t in texts()]
    whole = media.to_files(data)
    monkeypatch.setattr(media, "ENCODE_TOGETHER", 1000)
    monkeypatch.setattr(media, "DECODE_TOGETHER", 1000)
    assert media.to_files(data) == whole
    assert [x.tobytes() for x in media.from_files(whole)] == data


def test_pixels_column(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = media.decode_media(media.encode_media(df)).orderBy("doc_id").collect()
    assert [(r.height, r.width, bytes(r.pixels)) for r in got] == [(1, 64, b"abc" + b" " * 189), (1, 64, b" " * 192)]
    nothing = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, media binary")
    assert [tuple(r)[1:] for r in media.decode_media(nothing).collect()] == [(None, None, None)] * 2
    assert media.encode_media(df.limit(0)).count() == 0


def test_block_hashes():
    x = np.zeros((16, 64, 3), np.uint8)
    x[:8] = 200
    assert media.block_hashes([x]) == ["ffffffff00000000"]
