import hashlib
import math
import random
import re
from collections import Counter

from siftline.llm import secret_scan as ss


def base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def texts():
    rng = random.Random(4)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "é", "ſecret", "\n", "Zx9", "/", "_", ".", "secret", "same" * 5]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)]
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    return [*out, "", None, f"see {key} here", f"example{key}", "a" * 100_000 + f" {key}", f"token = {key}", "123e4567-e89b-12d3-a456-426614174000"], key


def test_base_spans_match_brute_force(spark, tmp_path):
    rows, key = texts()
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in ss.query(spark, str(tmp_path)).collect():
        want = base(rows[r.doc_id] or "")
        joined = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        counts = Counter(k for _, k, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts[0], counts[1], counts[2])
        kept = [s for s in r.spans.split(",") if s.split(":")[0] in ss.KINDS[:3]]
        assert ",".join(kept) == joined


def test_entropy_spans():
    _, key = texts()
    scan = ss.Scanner()
    assert (4, 44, ss.ENTROPY_BASE64) in scan(f"see {key} here")
    for clean in (f"example{key}", "123e4567-e89b-12d3-a456-426614174000", "thaninthehetiontiontionstthth" * 5, "Aa1" * 30, "word " * 100):
        assert not scan(clean)


def test_keys_of_one_case():
    scan, rng = ss.Scanner(), random.Random(8)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        keys = ["".join(rng.choices(letters + "0123456789", k=40)) for _ in range(200)]
        found = [any(k == ss.ENTROPY_ONE_CASE and 4 <= a < b <= 44 for a, b, k in scan(f"see {key} here")) for key in keys]
        assert sum(found) >= 198
        assert not any(scan(f"example{key}" if letters.islower() else f"EXAMPLE{key}") for key in keys)
    for clean in ("internationalization2024 " * 3, "a1" * 40, "chapter1" * 10, "A" * 50 + "1"):
        assert not [s for s in scan(clean) if s[2] == ss.ENTROPY_ONE_CASE], clean


def test_the_allow_list_silences_only_its_part():
    secret = "aB3dE5fG7hI9jK1lM2nO4pQ6"
    scan = ss.Scanner()
    for text, at in ((secret, 0), (f"docs/example/{secret}", 13), (f"your-bucket/{secret}", 12), (f"{secret}/xxxxxxxx", 0)):
        assert (at, at + 24, ss.ENTROPY_BASE64) in [(max(a, at), min(b, at + 24), k) for a, b, k in scan(text)], text
    blob = "".join(random.Random(2).choices("abcdefghABCDEFGH01234567", k=20_000))
    total = lambda text: sum(b - a for a, b, k in scan(text) if k == ss.ENTROPY_BASE64)
    spans = [s for s in scan(blob + "xxxxxx" + blob) if s[2] == ss.ENTROPY_BASE64]
    assert 2 * total(blob) - 200 < total(blob + "xxxxxx" + blob) <= 2 * total(blob) and all(b <= 20_000 or a >= 20_006 for a, b, _ in spans)


def test_windows_match_recounting():
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choices("aB3" if rng.random() < 0.3 else "abcdefghABCDEFGH01234567", k=rng.randint(0, 60)))
        window, bits = rng.choice([(5, 2.0), (20, 3.5)])
        hit = set()
        for i in range(len(s) - window + 1):
            c = Counter(s[i : i + window])
            if -sum(n / window * math.log2(n / window) for n in c.values()) >= bits - 1e-9:
                hit |= set(range(i, i + window))
        got = ss.entropy_windows(s, window, bits)
        assert {i for a, b in got for i in range(a, b)} == hit
        assert all(b < c for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ss.scan_secrets(df).count() == 0
    df = spark.createDataFrame([(1, "x", 2), (1, "x", 2), (None, None, None)], "spans long, text string, kind long")
    got = ss.scan_secrets(df, id_col="spans")
    assert got.columns == ["spans_key", "spans"] and got.count() == 3
