"""What each recognizer takes and leaves, and where it says that it stands."""

import pytest
from pyspark.sql import functions as F
from siftline.operators import recognizers as rec
from siftline.operators.suppress import Rules
from siftline.plans import fixtures
from siftline.plans.scan import Options, findings, scan

TAIL = "aB3dE6gH9" * 12
Z = "Z" * 16
HEX32 = "0a1b2c3d4e5f6789" * 2

ACCEPT = [
    ("EMAIL_ADDRESS", "user@example.com", None),
    ("EMAIL_ADDRESS", "user.name+tag@sub.domain.co", None),
    ("EMAIL_ADDRESS", "é.x@exemple.fr", None),
    ("EMAIL_ADDRESS", "parked_{x}@y.com real@example.com", "real@example.com"),
    ("CREDIT_CARD", "4532015112830366", None),
    ("CREDIT_CARD", "4532-0151-1283-0366", None),
    ("US_PHONE", "Call (415) 555-2671 today", "415) 555-2671"),
    ("US_PHONE", "+1 415-555-2671", None),
    ("US_PHONE", "cell 4155552671", "4155552671"),
    ("INTL_PHONE", "+44 20 7946 0958", None),
    ("US_SSN", "123-45-6789", None),
    ("US_SSN", "ssn: 123456789", "123456789"),
    ("IP_ADDRESS", "DNS: 8.8.8.8", "8.8.8.8"),
    ("IP_ADDRESS", "10.1.2.3/24", None),
    ("IP_ADDRESS", "2001:4860:4860::8888", None),
    ("IP_ADDRESS", "x 1:2:3:4:5:6:7:8.", "1:2:3:4:5:6:7:8"),
    ("URL", "https://example.com/path", None),
    ("URL", "see foo.py:10", "foo.py:10"),
    ("MAC_ADDRESS", "01:23:45:67:89:AB", None),
    ("MAC_ADDRESS", "01-23-45-67-89-ab", None),
    ("MAC_ADDRESS", "0123.4567.89AB", None),
    ("IBAN_CODE", "GB82WEST12345698765432", None),
    ("CRYPTO", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", None),
    ("CRYPTO", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", None),
    *(("SECRET_AWS_ACCESS_KEY", p + Z, None) for p in ("AK" + "IA", "A3" + "T0", "AB" + "IA", "AC" + "CA", "AS" + "IA")),
    ("SECRET_GITHUB_TOKEN", "gh" + "p_" + TAIL[:36], None),
    *(("SECRET_SLACK_TOKEN", f"xox{c}-" + "1234567890-abc", None) for c in "posrb"),
    ("SECRET_STRIPE_KEY", "sk" + "_live_" + TAIL[:24], None),
    ("SECRET_STRIPE_KEY", "rk" + "_live_" + TAIL[:24], None),
    ("SECRET_GOOGLE_API_KEY", "AI" + "za" + TAIL[:35], None),
    ("SECRET_JWT", "ey" + "Jh.ey" + "Jz.c2ln", None),
    *(("SECRET_PRIVATE_KEY", f"-----BEGIN {k}PRIVATE KEY-----", None) for k in ("RSA ", "", "OPENSSH ")),
    ("SECRET_NPM_TOKEN", "np" + "m_" + TAIL[:36], None),
    ("SECRET_TWILIO_KEY", "S" + "K" + "x" * 32, None),
    ("SECRET_SENDGRID_KEY", "S" + "G." + TAIL[:22] + "." + TAIL[:43], None),
    ("SECRET_SQUARE_OAUTH", "sq" + "0csp-" + TAIL[:20] + "\\" + TAIL[:22], None),
    ("SECRET_MAILGUN_KEY", "ke" + "y-" + HEX32, None),
    ("SECRET_MAILCHIMP_KEY", HEX32 + "-u" + "s30", None),
    ("SECRET_MAILCHIMP_KEY", HEX32 + "-u" + "s2", None),
    ("SECRET_DISCORD_BOT_TOKEN", "M" + TAIL[:23] + "." + TAIL[:6] + "." + TAIL[:27], None),
    ("SECRET_PYPI_TOKEN", "py" + "pi-" + "AgE" + "NdGVzdC5weXBpLm9yZw" + TAIL[:90], None),
    ("SECRET_KEYWORD_ASSIGNMENT", 'password = "hunter2real"', "hunter2real"),
    ("SECRET_KEYWORD_ASSIGNMENT", "POSTGRES_PASSWORD: postgres", "postgres"),
    ("SECRET_KEYWORD_ASSIGNMENT", 'API_KEY:\n  "Hk7d2ZpQ"', "Hk7d2ZpQ"),
    ("US_DRIVER_LICENSE", "AB1234567", None),
    ("US_PASSPORT", "C12345678", None),
    ("SECRET_HEX_HIGH_ENTROPY", f"'{HEX32}'", HEX32),
    ("SECRET_BASE64_HIGH_ENTROPY", '"kJ8xQ2mZ7vR4tY1wB6nP3cL9sD5fG0hAuEiOgTqXrVyUzKlMjNbWaSdFhCe/"', "kJ8xQ2mZ7vR4tY1wB6nP3cL9sD5fG0hAuEiOgTqXrVyUzKlMjNbWaSdFhCe/"),
]
REJECT = [
    ("EMAIL_ADDRESS", 'f"parked_{user.id}_{ts}@x.com" ${name}@x.org {{user}}@x.org org/redis-action@1.8.1'),
    ("CREDIT_CARD", "6.349667550340612 4111 1111 1111 1111 4532015112830367 x4532015112830366 4532015112830366_"),
    ("PHONE_NUMBER", '3.214.229.114 "1234567890" phone: 1234567890 sig=abc432562433694def 75.3128264600394'),
    ("US_SSN", "sample_id: 123456789 000-12-3456 666-12-3456 912-12-3456"),
    ("IP_ADDRESS", '127.0.0.1 0.0.0.0 255.255.255.255 169.254.1.1 192.0.2.1 198.51.100.7 203.0.113.9 1.2.543.1.34.1.34.134'),
    ("IP_ADDRESS", 'version = 1.2.3.4'),
    ("IP_ADDRESS", '<svg d="M1.5.75.75">'),
    ("IP_ADDRESS", "::1 2001:db8::1 ::endgroup:: std::vector"),
    ("URL", "foo.py user@host.com"),
    ("IBAN_CODE", "GB82WEST12345698765433"),
    ("CRYPTO", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivAAA"),
    ("SECRET_AWS_ACCESS_KEY", "AK" + "IA" + "z" * 16 + " AK" + "IA1234567"),
    ("SECRET_GITHUB_TOKEN", "foo_" + TAIL[:36]),
    ("SECRET_STRIPE_KEY", "pk" + "_live_" + TAIL[:24] + " sk" + "_live_"),
    ("SECRET_JWT", "ey" + "Jh.ey" + "Jz ey" + "Jh"),
    ("SECRET_PRIVATE_KEY", "-----BEGIN PUBLIC KEY-----"),
    ("SECRET_SENDGRID_KEY", "AG." + TAIL[:22] + "." + TAIL[:43] + " SG.." + TAIL[:43]),
    ("SECRET_MAILCHIMP_KEY", f"{HEX32}-2 {HEX32}-al32 {HEX32.upper()}-us30"),
    ("SECRET_DISCORD_BOT_TOKEN", "P" + "x" * 23 + "." + TAIL[:6] + "." + TAIL[:27]),
    ("SECRET_PYPI_TOKEN", "py" + "pi-" + "AgE" + "IcHlwaS5vcmc" + TAIL[:40]),
    ("SECRET_KEYWORD_ASSIGNMENT", '1password = "latest"\npassword=faker_instance.password(),\nsecret: "changeme" secret: xxxxxxxx bearer: "${VAULT_KEY}" password: YOUR_PASSWORD "password": "abcdef"'),
    ("SECRET_HEX_HIGH_ENTROPY", f"'{'0' * 32}' 'abc123' {HEX32}"),
    ("SECRET_BASE64_HIGH_ENTROPY", f"'{'ab' * 30}' '{HEX32}'"),
]


def everything():
    from dataclasses import replace

    return Options(recognizers=tuple(replace(r, tier=rec.STRICT) for r in rec.DEFAULT))


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"a{i}", t) for i, (_, t, _) in enumerate(ACCEPT)] + [(f"r{i}", t) for i, (_, t) in enumerate(REJECT)]
    rows += fixtures.rows() + [("odd0", "é\r\nx é user@example.com 日本 8.8.8.8\r\n\nlast a@b.org"), ("odd1", 'password:\n\n  "two\nlines here"')]
    got: dict[str, list] = {}
    docs = spark.createDataFrame(rows, "file string, text string")
    for r in findings(scan(docs, options=everything())).collect():
        got.setdefault(r.file, []).append(r)
    return got, dict(rows)


@pytest.mark.parametrize("i", range(len(ACCEPT)))
def test_accepts(found, i):
    entity, text, want = ACCEPT[i]
    assert (want or text) in [r.text for r in found[0].get(f"a{i}", []) if r.entity_type == entity]


@pytest.mark.parametrize("i", range(len(REJECT)))
def test_rejects(found, i):
    entity = REJECT[i][0]
    types = ("US_PHONE", "INTL_PHONE") if entity == "PHONE_NUMBER" else (entity,)
    assert not [r for r in found[0].get(f"r{i}", []) if r.entity_type in types]


def test_columns_are_bytes_of_the_line(found):
    got, texts = found
    n = 0
    for file, rows in got.items():
        lines = texts[file].split("\n")
        for r in rows:
            assert r.line_content == lines[r.line_num - 1]
            if "\n" not in r.text:
                assert r.line_content.encode()[r.col_start : r.col_end].decode() == r.text
                n += 1
    assert n > 100
    assert [(r.line_num, r.text) for r in got["odd0"] if r.entity_type == "EMAIL_ADDRESS"] == [(2, "user@example.com"), (4, "a@b.org")]
    over = [r for r in got["odd1"] if r.entity_type == "SECRET_KEYWORD_ASSIGNMENT"]
    assert [(r.line_num, r.col_start, r.text) for r in over] == [(3, 3, "two\nlines here")] and over[0].col_end == 3 + len("two\nlines here")


def test_scores(found):
    by_type = {r.entity_type: r.score for rows in found[0].values() for r in rows if not r.text.startswith("bc1")}
    assert by_type["EMAIL_ADDRESS"] == 1 and by_type["URL"] == pytest.approx(0.6) and by_type["SECRET_KEYWORD_ASSIGNMENT"] == pytest.approx(0.4) and by_type["US_PASSPORT"] == 0.5


def test_a_rejected_match_consumes_its_text(spark):
    docs = spark.createDataFrame([("f", "1.2.3.4.5.6.7.8 9.9.9.9")], "file string, text string")
    got = findings(scan(docs, options=Options(recognizers=rec.by_entity("IP_ADDRESS")))).collect()
    assert [r.text for r in got] == ["9.9.9.9"]


def test_base58_and_checksums(spark):
    from siftline.functions import text as t
    from siftline.functions.base58 import base58check

    rows = [("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa",), ("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy",), ("1111111111111111111114oLvT2",), ("11",), ("0OIl",), ("",), ("GB82WEST12345698765432",), ("GB82WEST12345698765431",)]
    df = spark.createDataFrame(rows, "x string")
    got = df.select(base58check(F.col("x")).alias("b"), t.mod97_is_one(F.col("x")).alias("m")).collect()
    assert [r.b for r in got[:6]] == [True, True, True, False, False, False]
    assert [r.m for r in got[6:]] == [True, False]


def test_entropy(spark):
    from siftline.functions import text as t

    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcdefgh",)], "x string")
    assert [r[0] for r in df.select(t.shannon_entropy(F.col("x"))).collect()] == [0, 0, 1, 3]
