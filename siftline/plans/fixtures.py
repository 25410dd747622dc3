"""Small texts with what the test tables lack. Credentials are put together here, so that none stands in the sources."""

from __future__ import annotations


def texts() -> list[str]:
    tail = "aB3" * 20
    return [
        "mail real@example.com and f\"parked_{x}@y.com\" or org/action@1.8.1, user.name+tag@sub.domain.co",
        "${name}@x.org {{user}}@x.org a.@b.cc .a@b.cc a@b a@b.c1 ete@exemple.fr",
        "4532015112830366 4532-0151-1283-0366 6.349667550340612 4111 1111 1111 1111 x4532015112830366",
        "Call (415) 555-2671 today\n+44 20 7946 0958\n3.214.229.114 \"2345678901\"\nphone: 2345678901 sig=abc432562433694def 75.3128264600394",
        "123-45-6789 000-12-3456 666-12-3456 912-12-3456\nssn: 123456789\nsample_id: 123456789",
        "DNS: 8.8.8.8 10.0.0.1/24 127.0.0.1 0.0.0.0 192.0.2.7\nversion = 1.2.3.4\n1.2.543.1.34.1.34.134 <svg d=\"M1.5.75.75\">",
        "2001:4860:4860::8888 ::1 2001:db8::1 ::endgroup:: fe80::1 2001:0db8:85a3:0000:0000:8a2e:0370:7334 1:2:3:4:5:6:7:8 ::ffff:1.2.3.4",
        "https://example.com/path foo.py foo.py:10 HTTPS://EXAMPLE.COM x.org/a(b) user@host.com/x http://a.bc:8080/?q=<b>",
        "01:23:45:67:89:AB 01-23-45-67-89-ab 0123.4567.89AB 01:23:45:67:89:ABC",
        "GB82WEST12345698765432 GB82WEST12345698765433 DE89370400440532013000",
        "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivAAA bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq",
        " ".join(p + "Z" * 16 for p in ("AK" + "IA", "A3" + "T0", "AB" + "IA", "AC" + "CA", "AS" + "IA")) + " " + "AK" + "IA" + "z" * 16,
        "gh" + "p_" + "A1b2" * 9 + " foo_" + "A1b2" * 9 + " xox" + "b-" + "12345-abcdef" + " sk" + "_live_" + tail[:24] + " pk_live_" + tail[:24],
        "AI" + "za" + tail[:35] + " ey" + "Jhbg.ey" + "Jzdw.c2ln ey" + "Jhbg.ey" + "Jzdw",
        "-----BEGIN " + "RSA PRIVATE KEY-----\n-----BEGIN " + "PRIVATE KEY-----\n-----BEGIN PUBLIC KEY-----",
        "np" + "m_" + tail[:36] + " A" + "C" + "x" * 32 + " S" + "G." + tail[:22] + "." + tail[:43] + " sq" + "0csp-" + tail[:20] + "\\" + tail[:22],
        "ke" + "y-" + "0a1b" * 8 + " " + "0a1b" * 8 + "-u" + "s12 " + "0a1b" * 8 + "-2",
        "M" + tail[:24] + "." + tail[:6] + "." + tail[:27] + " py" + "pi-" + "AgE" + "IcHlwaS5vcmc" + tail + tail[:25],
        'password = "hunter2real"\nPOSTGRES_PASSWORD: postgres\nAPI_KEY: "Hk7d2ZpQ" 1password = "latest"\npassword=faker_instance.password(),\nsecret: changeme secret: "xxxxxxxx" bearer: ${VAULT_KEY}',
        "'" + "0123456789abcdef" * 2 + "' '" + "0" * 32 + "' \"abcdef\" '" + "deadbeef" * 4 + "'",
        "\"" + "kJ8xQ2mZ7vR4tY1wB6nP3cL9sD5fG0hAuEiOgTqXrVyUzKlMjNbWaSdFhCePoI" + "\" '" + "ab" * 20 + "'",
        "licence AB1234567 and passport C12345678\nX123456 D1234567890",
        "día 8.8.4.4 über é user@example.org\r\nsecond é line a@b.org\r\n\nlast c@d.org",
    ]


def rows() -> list[tuple[str, str]]:
    return [(f"fixtures/{k}.txt", x) for k, x in enumerate(texts())]
