"""Recognizers: a text becomes an array of matches, in native expressions.

A rejected match still consumes its characters (its text is empty then). Places come from the text alone, so an operator needs no files.
Each has a guard, a cheap condition that any match implies, so that most rows skip its pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.functions.base58 import base58check

STRICT, BROAD, OPT_IN = "strict", "broad", "opt_in"


@dataclass(frozen=True)
class Recognizer:
    """entity: the name that switches it off; emits: the types of its findings, where these differ; screen: a pattern that
    any match implies, shared with other recognizers; table: patterns of which every match is a finding (see t.matches_of),
    tried together with those of other recognizers."""

    entity: str
    tier: str
    guard: Callable[[Column], Column]
    find: Callable[[Column], Column]
    emits: tuple[str, ...] = ()
    screen: str = ""
    table: tuple[tuple[str, str, float, tuple[str, ...]], ...] = ()

    def matches(self, text: Column) -> Column:
        return F.when(self.guard(text), self.find(text)).otherwise(t.no_matches())


def has(*words: str) -> Callable[[Column], Column]:
    return lambda text: t.contains_any(text, words)


def like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def both(*guards: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """All of them, the cheapest first."""
    return lambda text: reduce(lambda a, b: a & b, (g(text) for g in guards))


def plain(entity: str, pattern: str, words: tuple[str, ...] = ("",), tier: str = STRICT, score: float = 1.0) -> Recognizer:
    """Every match is a finding; words: one of them is in any match."""
    table = ((entity, pattern, score, words),)
    return Recognizer(entity, tier, lambda text: F.lit(True), lambda text: t.matches_of(text, list(table)), table=table)


def checked(entity: str, pattern: str, guard: Callable, keep: Callable[[dict], Column], score: float | Callable = 1.0, tier: str = STRICT, **how) -> Recognizer:
    """Matches for which keep(match) holds, which has `text` too; score may be a function of the match. how: as for t.matches."""

    def row(x: dict) -> dict:
        x = x | {"text": x["m"]}
        return {"entity_type": F.lit(entity), "score": score(x) if callable(score) else F.lit(score), "text": F.when(keep(x), x["m"]).otherwise("")}

    return Recognizer(entity, tier, guard, lambda text: t.matches(text, pattern, row, **how))


def grouped(entity: str, pattern: str, guard: Callable, keep: Callable[[dict], Column], tail: int, score: float, tier: str = STRICT, **how) -> Recognizer:
    """The finding is group 1, which ends `tail` characters before the match."""

    def row(x: dict) -> dict:
        return {"entity_type": F.lit(entity), "score": F.lit(score), "text": F.when(keep(x | {"text": x["g1"]}), x["g1"]).otherwise(""), "tail": F.lit(tail)}

    return Recognizer(entity, tier, guard, lambda text: t.matches(text, pattern, row, groups=1, **how))


# The patterns by which findings are defined. (?U) gives \w, \d, \s and \b their Unicode meaning.
# Java's engine backtracks, so loops are possessive where that changes no match, and a long run in which no match can
# start any more is taken whole (to be left out later) instead of being tried again from each of its words.

ATOM, ATOMS = r"[!#$%&'*+\-/=?^_`{|}~\w]", r"[!#$%&'*+\-/=?^_`{|}~.\w]"
EMAIL = rf"(?U)\b{ATOM}(?:{ATOMS}*+(?<!\.)@\w++(?:-\w++)*+\.\w++(?:[-.]\w++)*+\b|(?={ATOMS}{{64}}){ATOMS}++)"
CARD = r"(?U)\b(?:4\d{3}|5[0-5]\d{2}|6\d{3}|1\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b"
PHONE = r"(?U)\+?\d{1,3}?[-. ]?\(?\d{2,4}\)?[-. ]?\d{3,4}[-. ]?\d{3,5}"
SSN = r"(?U)\b(?:[0-8]\d{2}|7(?:[0-6]\d|7[012]))(?:-\d{2}-\d{4}|\d{2}\d{4})\b"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"(?U)\b{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?:/(?:[0-2]?\d|3[0-2]))?\b"
IPV4_NOT = r"^127\.|^0\.0\.0\.0|^255\.255\.255\.255|^169\.254\.|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\."
IPV4_LINE_NOT = r"""<svg|<path|viewBox|d=["']?[Mm]|fill-rule|stroke-width|(?Ui)\bversion\s*[:=]"""
H = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"(?U)(?:^|[^\w:])((?:{H}:){{7}}{H}|(?:{H}:){{1,6}}:{H}|(?:{H}:){{1,5}}(?::{H}){{1,2}}|(?:{H}:){{1,4}}(?::{H}){{1,3}}"
    rf"|(?:{H}:){{1,3}}(?::{H}){{1,4}}|(?:{H}:){{1,2}}(?::{H}){{1,5}}|{H}:(?::{H}){{1,6}}"
    rf"|::(?:ffff(?::0{{1,4}})?:)?(?:{OCTET}\.){{3}}{OCTET}|::(?::{H}){{1,7}}|(?:{H}:){{1,7}}:|::{H})"
)
LABEL = r"[a-z0-9\-]++"
URL = rf"""(?Ui)\b(?:https?://)?+(?:(?:{LABEL}(?:\.(?![a-z]{{2}}){LABEL})*+\.(?=[a-z]{{2}}))++([a-z]{{2,63}}+)(?::\d+)?(?:/[^\s\)\]\}}'"<>]*+)?|(?=[a-z0-9\-.]{{64}}){LABEL}(?:\.{LABEL})*+)"""
MAC = r"(?U)\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"
MAC_DOTTED = r"(?U)\b[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\b"
IBAN = r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
CRYPTO = r"(?U)\b(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}\b"
LICENSE = r"(?U)\b[A-Z]{1,3}\d{6,15}\b"
PASSPORT = r"(?U)\b[A-Z]{1,2}\d{6,9}\b"
KEYWORD = r"""(?Ui)(?:^|[^A-Za-z0-9])(?:passwd|password|secret|api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|bearer)(?:[A-Za-z0-9_\-]*+\s*+[:=]\s*+(?:["']([^"']{4,})["']|([A-Za-z0-9_\-]{4,}))|(?=[A-Za-z0-9_\-]{64})[A-Za-z0-9_\-]++)"""
JWT = r"(?U)\beyJ(?:[A-Za-z0-9_\-]++\.eyJ[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]+\b|(?=[A-Za-z0-9_\-]{64})[A-Za-z0-9_\-]++)"
QUOTED_HEX = r"""["']([0-9a-fA-F]{32,})["']"""
QUOTED_BASE64 = r"""["']([A-Za-z0-9+/_\-]{20,})["']"""
PHONE_WORDS = ("phone", "tel:", "telephone", "cell", "cellphone", "mobile", "call ", "fax", "contact", "whatsapp", "sms")
SSN_WORDS = ("ssn", "social security", "social_security", "socialsecurity", "ss#", "ss num", "tax id", "taxpayer id")
PLACEHOLDER_WORDS = ("changeme", "example", "placeholder", "your_", "yourpassword", "password", "dummy", "redacted", "<secret>", "<password>", "todo", "none", "null")
LOCAL_IPV6 = ("::1", "::", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0")
HEX_BITS, BASE64_BITS = 3.0, 4.5

# Fixed values as well.
#: Credentials whose pattern is all there is to check: entity, pattern, and words of which any match holds one.
CREDENTIALS = (
    ("SECRET_AWS_ACCESS_KEY", r"(?U)\b(?:AKIA|ASIA|AIDA|AROA|AGPA|AIPA|ACCA|ABIA|A3T0|ANPA|ANVA)[0-9A-Z]{16}\b", ("AKIA", "ASIA", "AIDA", "AROA", "AGPA", "AIPA", "ACCA", "ABIA", "A3T0", "ANPA", "ANVA")),
    ("SECRET_GITHUB_TOKEN", r"(?U)\b(?:gh[pousr])_[A-Za-z0-9_]{36,251}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("SECRET_SLACK_TOKEN", r"(?U)\bxox[abprsoe]-[A-Za-z0-9\-]{10,}\b", ("xox",)),
    ("SECRET_STRIPE_KEY", r"(?U)\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,247}\b", ("k_live_", "k_test_")),
    ("SECRET_GOOGLE_API_KEY", r"(?U)\bAIza[0-9A-Za-z_\-]{35}\b", ("AIza",)),
    ("SECRET_PRIVATE_KEY", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    ("SECRET_NPM_TOKEN", r"(?U)\bnpm_[A-Za-z0-9]{36}\b", ("npm_",)),
    ("SECRET_TWILIO_KEY", r"(?U)\b(?:AC|SK)[a-z0-9]{32}\b", ("AC", "SK")),
    ("SECRET_SENDGRID_KEY", r"(?U)\bSG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}\b", ("SG.",)),
    ("SECRET_SQUARE_OAUTH", r"(?U)\bsq0csp-[0-9A-Za-z\\\-_]{43}\b", ("sq0csp-",)),
    ("SECRET_MAILGUN_KEY", r"(?U)\bkey-[0-9a-f]{32}\b", ("key-",)),
    ("SECRET_MAILCHIMP_KEY", r"(?U)\b[0-9a-f]{32}-us\d{1,2}\b", ("-us",)),
    ("SECRET_DISCORD_BOT_TOKEN", r"(?U)[MNO][a-zA-Z\d_\-]{23,25}\.[a-zA-Z\d_\-]{6}\.[a-zA-Z\d_\-]{27}", ("M", "N", "O")),
    ("SECRET_PYPI_TOKEN", r"(?U)\bpypi-(?:AgEIcHlwaS5vcmc|AgENdGVzdC5weXBpLm9yZw)[A-Za-z0-9_\-]{80,}\b", ("pypi-AgE",)),
)


def _outside(s: dict, extra: str) -> Column:
    """Neither neighbour is an ASCII letter or digit or one of `extra`."""
    touching = f"[A-Za-z0-9{extra}]"
    return ~t.before(s).rlike(touching) & ~t.after(s).rlike(touching)


def _email(s: dict) -> Column:
    last = F.substring_index(s["text"], ".", -1)
    tld = F.when(F.contains(last, F.lit("@")), F.substring_index(s["text"], "@", -1)).otherwise(last)
    local = F.substring(s["text"], F.lit(1), F.length(s["text"]) - F.length(F.substring_index(s["text"], "@", -1)) - 1)
    return F.contains(s["text"], F.lit("@")) & tld.rlike("[A-Za-z]") & ~local.rlike(r"[{}]")


def _card(s: dict) -> Column:
    d = t.digits(s["text"])
    return _outside(s, "._") & F.length(d).between(13, 19) & (t.distinct_characters(d) >= 4) & F.call_function("luhn_check", d)


def _phone_shape(s: dict) -> Column:
    """All that is asked of a phone number itself but the numbering plan."""
    raw = F.trim(s["m"])
    d = t.digits(raw)
    national = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).when(F.length(d) == 10, d).otherwise(F.lit(""))
    groups = F.regexp_replace(raw, r"^\+", "").rlike(r"[-. ()]") & raw.rlike(r"(?U)\d{6,}")
    return (
        _outside(s, r"\-._")
        & F.length(d).between(10, 15)
        & ~groups
        & ((national == "") | national.rlike("^[2-9]..[2-9]"))
        & ~raw.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    )


#: Approximate numbering plans by country code: lengths of national numbers, and what they start with.
PLANS = (
    ("44", 9, 10, "[1-9]"),
    ("49", 6, 11, "[1-9]"),
    ("33", 9, 9, "[1-9]"),
    ("972", 8, 9, "[2-9]"),
    ("91", 10, 10, "[1-9]"),
    ("55", 10, 11, "[1-9]"),
    ("34", 9, 9, "[5-9]"),
    ("39", 6, 11, "[03]"),
    ("31", 9, 9, "[1-9]"),
    ("32", 8, 9, "[1-9]"),
    ("41", 9, 9, "[1-9]"),
    ("43", 7, 13, "[1-9]"),
    ("45", 8, 8, "[2-9]"),
    ("46", 7, 10, "[1-9]"),
    ("47", 8, 8, "[2-9]"),
    ("48", 9, 9, "[1-9]"),
    ("52", 10, 10, "[1-9]"),
    ("61", 9, 9, "[1-9]"),
    ("64", 8, 10, "[2-9]"),
    ("65", 8, 8, "[3689]"),
    ("7", 10, 10, "[3489]"),
    ("81", 9, 10, "[1-9]"),
    ("82", 8, 10, "[1-9]"),
    ("86", 10, 11, "[1-9]"),
    ("27", 9, 9, "[1-8]"),
    ("351", 9, 9, "[2-9]"),
    ("353", 7, 9, "[1-9]"),
    ("358", 6, 11, "[1-9]"),
)
NANP = "^[2-9][0-8][0-9][2-9][0-9]{6}$"


def phone_country(raw: Column) -> Column:
    """'1' for a valid number of the North American plan, another code for a valid one elsewhere, else null.

    A number without `+` (or 011) is judged by the North American plan alone, as the fallback to other regions applies
    only where a number can't be read at all. Area codes follow the plan's rule, not the list of those in service.
    """
    d = t.digits(raw)
    world = F.when(raw.startswith("+"), d).when(d.startswith("011"), F.substring(d, F.lit(4), F.length(d)))
    home = F.when(F.length(d) == 11, F.regexp_replace(d, "^1", "")).otherwise(d)
    american = F.when(F.substring(world, F.lit(2), F.length(world)).rlike(NANP), F.lit("1"))
    # A trunk 0 may stand in brackets after the country code.
    plans = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(f"^{c}0?{lead}[0-9]{{{least - 1},{most - 1}}}$").alias("shape")) for c, least, most, lead in PLANS))
    abroad = F.get(F.filter(plans, lambda p: F.rlike(world, p["shape"])), F.lit(0))["code"]
    return F.when(world.isNotNull(), F.when(world.startswith("1"), american).otherwise(abroad)).when(home.rlike(NANP), F.lit("1"))


def _phone(text: Column) -> Column:
    """A number without separators counts only on a line that speaks of phones."""

    def row(x: dict) -> dict:
        country = F.when(_phone_shape(x), phone_country(F.trim(x["m"])))
        return {
            "entity_type": F.when(country == "1", "US_PHONE").otherwise("INTL_PHONE"),
            "score": F.lit(1.0),
            "text": F.when(country.isNotNull(), x["m"]).otherwise(""),
            "line_rule": F.when(F.trim(x["m"]).rlike(r"[^0-9+]"), 0).otherwise(ON_PHONE_LINE),
        }

    return t.matches(text, PHONE, row, around=True)


def _ssn(text: Column) -> Column:
    """A number without hyphens counts only on a line that names it."""

    def row(x: dict) -> dict:
        area = F.substring(x["m"], 1, 3)
        good = ~area.isin("000", "666") & ~area.startswith("9")
        return {"entity_type": F.lit("US_SSN"), "score": F.lit(1.0), "text": F.when(good, x["m"]).otherwise(""), "line_rule": F.when(F.contains(x["m"], F.lit("-")), 0).otherwise(ON_SSN_LINE)}

    return t.matches(text, SSN, row)


def _ipv4(text: Column) -> Column:
    def row(x: dict) -> dict:
        dotted = (t.before(x) == ".") & t.before(x, 2).rlike("[0-9]")
        goes_on = (t.after(x) == ".") & t.after(x, 2).rlike("[0-9]")
        good = ~dotted & ~goes_on & ~x["m"].rlike(IPV4_NOT)
        return {"entity_type": F.lit("IP_ADDRESS"), "score": F.lit(1.0), "text": F.when(good, x["m"]).otherwise(""), "line_rule": F.lit(NOT_A_VERSION)}

    return t.matches(text, IPV4, row, around=True)


#: Rules for whole lines, by the numbers under which matches name them.
ON_PHONE_LINE, ON_SSN_LINE, NOT_A_VERSION = 1, 2, 3
LINE_RULES = (
    lambda line: t.contains_any(t.lower_ascii(line), PHONE_WORDS),
    lambda line: t.contains_any(t.lower_ascii(line), SSN_WORDS),
    lambda line: ~line.rlike(IPV4_LINE_NOT),
)


def _ipv6(s: dict) -> Column:
    return ~t.after(s).rlike("[:A-Za-z0-9_]") & ~s["text"].isin(*LOCAL_IPV6) & ~s["text"].rlike("^2001:(?:db8|DB8):")


def _url(s: dict) -> Column:
    return (s["g1"] != "") & ~F.contains(s["text"], F.lit("@")) & (s["text"].startswith("http") | s["text"].rlike("[/:]"))


def _mac(text: Column) -> Column:
    return t.matches_of(text, [("MAC_ADDRESS", p, 1.0, ("",)) for p in (MAC, MAC_DOTTED)])


def is_placeholder(c: Column) -> Column:
    return c.rlike(r"^(?:[xX]*|\**|0*)$") | t.contains_any(t.lower_ascii(c), PLACEHOLDER_WORDS) | t.contains_any(c, ("${", "{{", "%("))


def _keyword(text: Column) -> Column:
    def row(x: dict) -> dict:
        quoted = x["g1"] != ""
        value = F.when(quoted, x["g1"]).otherwise(x["g2"])
        good = ~is_placeholder(value) & (quoted | ~t.after(x).isin(".", "(", "[", "="))
        return {"entity_type": F.lit("SECRET_KEYWORD_ASSIGNMENT"), "score": F.lit(0.4), "text": F.when(good, value).otherwise(""), "tail": F.when(quoted, 1).otherwise(0)}

    return t.matches(text, KEYWORD, row, groups=2, around=True)


def _defaults() -> tuple[Recognizer, ...]:
    keyword = lambda text: F.concat(F.lit(" "), text).rlike("(?i)[^A-Za-z0-9](?:passw|secret|api[_-]?key|access|auth|private|bearer)")
    return (
        checked("EMAIL_ADDRESS", EMAIL, has("@"), _email),
        checked("CREDIT_CARD", CARD, like(r"(?U)\d{4}[- ]?\d{3,4}[- ]?\d{3}"), _card, around=True),
        Recognizer("PHONE_NUMBER", STRICT, like(r"(?U)\d{3}[-. ]?\d{3}"), _phone, ("US_PHONE", "INTL_PHONE")),
        Recognizer("US_SSN", STRICT, like(r"(?U)\d{3}-\d{2}-\d{4}|\d{9}"), _ssn),
        Recognizer("IP_ADDRESS", STRICT, like(r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d"), _ipv4),
        grouped("IP_ADDRESS", IPV6, both(has(":"), like("[0-9A-Fa-f:]:[0-9A-Fa-f:.]")), _ipv6, 0, 1.0, around=True),
        checked("URL", URL, both(has("/", ":", "http"), like(r"(?i)\.[a-z]{2}")), _url, 0.6, groups=1),
        Recognizer("MAC_ADDRESS", STRICT, like(r"[:.\-][0-9A-Fa-f]{2}(?:[:-]|[0-9A-Fa-f]{2}\.)"), _mac),
        checked("IBAN_CODE", IBAN, like(r"[A-Z][A-Z](?U:\d)(?U:\d)[A-Z0-9]{11}"), lambda s: t.mod97_is_one(s["text"])),
        checked("CRYPTO", CRYPTO, like("(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25}"), lambda s: s["text"].startswith("bc1") | base58check(s["text"]), lambda s: F.when(s["text"].startswith("bc1"), 0.5).otherwise(1.0)),
        *(plain(e, p, g) for e, p, g in CREDENTIALS),
        checked("SECRET_JWT", JWT, has(".eyJ"), lambda s: F.contains(s["text"], F.lit("."))),
        Recognizer("SECRET_KEYWORD_ASSIGNMENT", STRICT, both(has(":", "="), keyword), _keyword),
        plain("US_DRIVER_LICENSE", LICENSE, tier=BROAD, score=0.5),
        plain("US_PASSPORT", PASSPORT, tier=BROAD, score=0.5),
        grouped("SECRET_HEX_HIGH_ENTROPY", QUOTED_HEX, like("[0-9a-fA-F]{32}"), lambda s: t.shannon_entropy(s["text"]) >= HEX_BITS, 1, 0.5, OPT_IN),
        grouped("SECRET_BASE64_HIGH_ENTROPY", QUOTED_BASE64, like(r"[A-Za-z0-9+/_\-]{20}"), lambda s: ~s["text"].rlike("^[0-9a-fA-F]+$") & (t.shannon_entropy(s["text"]) >= BASE64_BITS), 1, 0.5, OPT_IN),
    )


#: What a text must hold for whole groups of recognizers; most texts hold none of it, and skip the group. A screen is tried
#: on every text, so it starts with what is rare, or (LONG_RUN) goes over the text in one pass.
NUMBER, DOTTED = r"(?U)\d{3}[-. ]?\d{2}", r"\.(?U:\d)"
LONG_RUN = r"\A(?:(?U:[A-Za-z\d_\\\-]){0,19}+(?U:[^A-Za-z\d_\\\-])++)*+(?U:[A-Za-z\d_\\\-]){20}"
SCREENS = {
    **dict.fromkeys(("CREDIT_CARD", "PHONE_NUMBER", "US_SSN", "US_DRIVER_LICENSE", "US_PASSPORT"), NUMBER),
    **{e: LONG_RUN for e, _, _ in CREDENTIALS if e not in ("SECRET_SLACK_TOKEN", "SECRET_PRIVATE_KEY")},
    "CRYPTO": LONG_RUN,
}
DEFAULT = tuple(replace(r, screen=DOTTED if r.entity == "IP_ADDRESS" and i == 4 else SCREENS.get(r.entity, "")) for i, r in enumerate(_defaults()))
ENTITIES = tuple(dict.fromkeys(e for r in DEFAULT for e in (r.emits or (r.entity,))))


def by_entity(*names: str, among: tuple[Recognizer, ...] = DEFAULT) -> tuple[Recognizer, ...]:
    got = tuple(r for r in among if r.entity in names or set(r.emits) & set(names))
    if not got:
        raise ValueError(f"no recognizer for {', '.join(names)}")
    return got
