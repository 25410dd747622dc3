"""The recognizers in plain Python, with the patterns of an engine that doesn't backtrack: a check on the native ones."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from siftline.functions.base58 import ALPHABET
from siftline.operators import recognizers as rec
from siftline.plans import oracle


def _compiled(pattern: str) -> re.Pattern:
    flags = re.I if "(?Ui)" in pattern else 0
    return re.compile(pattern.replace("(?Ui)", "").replace("(?U)", ""), flags)


_ASCII = re.compile("[A-Za-z0-9]")


def _around(text: str, a: int, b: int, extra: str) -> bool:
    """A neighbour is an ASCII letter or digit or one of `extra`."""
    near = text[a - 1 : a] + text[b : b + 1] if a else text[b : b + 1]
    return any(_ASCII.match(c) or c in extra for c in near)


def _lower(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def mod97(s: str) -> bool:
    return bool(re.fullmatch("[0-9A-Za-z]+", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base58check(s: str) -> bool:
    n = 0
    for c in s:
        if c not in ALPHABET:
            return False
        n = n * 58 + ALPHABET.index(c)
    data = bytes(len(s) - len(s.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(data) >= 5 and hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def phone_country(raw: str) -> str | None:
    d = _digits(raw)
    world = d if raw.startswith("+") else d[3:] if d.startswith("011") else None
    if world is None:
        home = d[1:] if len(d) == 11 and d.startswith("1") else d
        return "1" if re.search(rec.NANP, home) else None
    if world.startswith("1"):
        return "1" if re.search(rec.NANP, world[1:]) else None
    return next((c for c, lo, hi, lead in rec.PLANS if re.search(f"^{c}0?{lead}[0-9]{{{lo - 1},{hi - 1}}}$", world)), None)


def _email(text, line, a, b, m):
    local, _, domain = m.rpartition("@")
    return re.search("[A-Za-z]", domain.rpartition(".")[2]) and not re.search("[{}]", local)


def _card(text, line, a, b, m):
    d = _digits(m)
    return not _around(text, a, b, "._") and 13 <= len(d) <= 19 and len(set(d)) >= 4 and luhn(d)


def _phone(text, line, a, b, m):
    raw, d = m.strip(" "), _digits(m)
    national = d[1:] if len(d) == 11 and d[0] == "1" else d if len(d) == 10 else ""
    if _around(text, a, b, "-._") or not 10 <= len(d) <= 15:
        return None
    if re.search(r"[-. ()]", raw.removeprefix("+")) and re.search(r"\d{6,}", raw):
        return None
    if not re.search("[^0-9+]", raw) and not any(w in _lower(line) for w in rec.PHONE_WORDS):
        return None
    if national and not re.match("[2-9]..[2-9]", national) or re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", raw):
        return None
    code = phone_country(raw)
    return code and ("US_PHONE" if code == "1" else "INTL_PHONE")


def _ssn(text, line, a, b, m):
    return m[:3] not in ("000", "666") and m[0] != "9" and ("-" in m or any(w in _lower(line) for w in rec.SSN_WORDS))


def _ipv4(text, line, a, b, m):
    dotted = a >= 2 and text[a - 1] == "." and text[a - 2] in "0123456789"
    goes_on = text[b : b + 1] == "." and text[b + 1 : b + 2] in tuple("0123456789")
    return not dotted and not goes_on and not re.search(rec.IPV4_NOT, m) and not _IPV4_LINE.search(line)


_IPV4_LINE = re.compile(rec.IPV4_LINE_NOT.replace(r"(?Ui)\bversion", r"\b(?i:version)"))


def _ipv6(text, line, a, b, m):
    return not re.match("[:A-Za-z0-9_]", text[b : b + 1]) and m not in rec.LOCAL_IPV6 and not re.match("2001:(?:db8|DB8):", m)


def _url(text, line, a, b, m):
    return "@" not in m and (m.startswith("http") or "/" in m or ":" in m)


def placeholder(v: str) -> bool:
    return bool(re.fullmatch(r"[xX]*|\**|0*", v)) or any(w in _lower(v) for w in rec.PLACEHOLDER_WORDS) or any(w in v for w in ("${", "{{", "%("))


def _keyword(text, line, a, b, m):
    quoted = a > 0 and text[a - 1] in "\"'" and text[b : b + 1] in ('"', "'")
    return not placeholder(m) and (quoted or text[b : b + 1] not in (".", "(", "[", "="))


#: (pattern, groups of which one is the finding, check, type where the check doesn't give it, score)
_always = lambda *a: True
RULES = [
    (_compiled(oracle.EMAIL), (0,), _email, "EMAIL_ADDRESS", 1.0),
    (_compiled(rec.CARD), (0,), _card, "CREDIT_CARD", 1.0),
    (_compiled(rec.PHONE), (0,), _phone, "PHONE_NUMBER", 1.0),
    (_compiled(rec.SSN), (0,), _ssn, "US_SSN", 1.0),
    (_compiled(rec.IPV4), (0,), _ipv4, "IP_ADDRESS", 1.0),
    (_compiled(rec.IPV6), (1,), _ipv6, "IP_ADDRESS", 1.0),
    (_compiled(oracle.URL), (0,), _url, "URL", 0.6),
    (_compiled(rec.MAC), (0,), _always, "MAC_ADDRESS", 1.0),
    (_compiled(rec.MAC_DOTTED), (0,), _always, "MAC_ADDRESS", 1.0),
    (_compiled(rec.IBAN), (0,), lambda t, ln, a, b, m: mod97(m), "IBAN_CODE", 1.0),
    (_compiled(rec.CRYPTO), (0,), lambda t, ln, a, b, m: m.startswith("bc1") or base58check(m), "CRYPTO", 1.0),
    *((_compiled(p), (0,), _always, e, 1.0) for e, p, _ in (*rec.CREDENTIALS, ("SECRET_JWT", oracle.JWT, ()))),
    (_compiled(oracle.KEYWORD), (1, 2), _keyword, "SECRET_KEYWORD_ASSIGNMENT", 0.4),
]


def find(text: str) -> Iterator[tuple[int, int, int, str, str, float]]:
    """(line, first byte, end byte, type, text, score) by strict recognizers, each place and type once, in order."""
    best: dict[tuple, tuple] = {}
    for pattern, groups, check, entity, score in RULES:
        for hit in pattern.finditer(text or ""):
            g = next((g for g in groups if hit[g] is not None), None)
            if g is None:
                continue
            a, b = hit.span(g)
            start = text.rfind("\n", 0, a) + 1
            end = text.find("\n", a)
            kind = check(text, text[start : end if end >= 0 else len(text)], a, b, hit[g])
            if not kind:
                continue
            kind = kind if isinstance(kind, str) else entity
            points = 0.5 if kind == "CRYPTO" and hit[g].startswith("bc1") else score
            col = len(text[start:a].encode("utf-8", "replace"))
            key = (text.count("\n", 0, a) + 1, col, col + len(hit[g].encode("utf-8", "replace")), kind)
            if key not in best or best[key][1] < points:
                best[key] = (hit[g], points)
    for key in sorted(best):
        yield (*key, *best[key])
