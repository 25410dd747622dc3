"""The same findings in plain SQL for DuckDB, written apart from the expressions: by line, over lists of matches."""

from __future__ import annotations

import re

from siftline.operators import recognizers as rec

from . import fixtures


# Patterns as they define findings, for an engine that doesn't backtrack.

EMAIL = r"(?U)\b(?:[!#$%&'*+\-/=?^_`{|}~\w]|[!#$%&'*+\-/=?^_`{|}~\w][!#$%&'*+\-/=?^_`{|}~.\w]{0,}[!#$%&'*+\-/=?^_`{|}~\w])@\w+(?:[-.]\w+)*\.\w+(?:[-.]\w+)*\b"
URL = r"""(?Ui)\b(?:https?://)?(?:[a-z0-9\-]+\.)+[a-z]{2,63}(?::\d+)?(?:/[^\s\)\]\}'"<>]*)?"""
KEYWORD = r"""(?Ui)(?:^|[^A-Za-z0-9])(?:passwd|password|secret|api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|bearer)[A-Za-z0-9_\-]*\s*[:=]\s*(?:["']([^"']{4,})["']|([A-Za-z0-9_\-]{4,}))"""
JWT = r"(?U)\beyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b"


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return literal(re.sub(r"\(\?U(i?)\)", lambda m: "(?i)" if m[1] else "", pattern))


def docs_sql(with_fixtures: bool = True) -> str:
    out = "SELECT CAST(doc_id AS VARCHAR) AS file, text FROM documents"
    if with_fixtures:
        out += " UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({literal(f)}, {literal(x)})" for f, x in fixtures.rows()) + ") AS fixtures(file, text)"
    return out


def _words(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {literal(w)})" for w in words) + ")"


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
TWICE = f"2 * CAST(substr({DIGITS}, length({DIGITS}) - k + 1, 1) AS INT)"
LUHN = f"list_sum(list_transform(generate_series(1, length({DIGITS})), lambda k: CASE WHEN k % 2 = 0 THEN {TWICE} - CASE WHEN {TWICE} > 9 THEN 9 ELSE 0 END ELSE {TWICE} // 2 END)) % 10 = 0"
MOD97 = (
    "list_reduce(list_prepend(0, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ord(x) - 48 ELSE ord(x) - 55 END)),"
    " lambda r, x: (r * (CASE WHEN x >= 10 THEN 100 ELSE 10 END) + x) % 97) = 1"
)
ENTROPY = "-list_sum(list_transform(list_distinct(string_split(m, '')), lambda c: (length(m) - length(replace(m, c, ''))) / length(m) * log2((length(m) - length(replace(m, c, ''))) / length(m))))"
NATIONAL = f"(CASE WHEN length({DIGITS}) = 11 AND starts_with({DIGITS}, '1') THEN substr({DIGITS}, 2) WHEN length({DIGITS}) = 10 THEN {DIGITS} ELSE '' END)"
PHONE_SHAPE = (
    f"NOT regexp_matches(prev, '[A-Za-z0-9._-]') AND NOT regexp_matches(next, '[A-Za-z0-9._-]') AND length({DIGITS}) BETWEEN 10 AND 15"
    " AND NOT (regexp_matches(m, '[-. ()]') AND regexp_matches(m, '[0-9]{6}'))"
    f" AND (regexp_matches(m, '[^0-9+]') OR {_words('line', rec.PHONE_WORDS)})"
    f" AND ({NATIONAL} = '' OR regexp_matches({NATIONAL}, '^[2-9]..[2-9]')) AND NOT regexp_matches(m, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$')"
)
_WORLD = f"(CASE WHEN starts_with(m, '+') THEN {DIGITS} WHEN starts_with({DIGITS}, '011') THEN substr({DIGITS}, 4) END)"
COUNTRY = (
    f"(CASE WHEN {_WORLD} IS NULL THEN (CASE WHEN regexp_matches(CASE WHEN length({DIGITS}) = 11 THEN regexp_replace({DIGITS}, '^1', '') ELSE {DIGITS} END, '{rec.NANP}') THEN '1' END)"
    f" WHEN starts_with({_WORLD}, '1') THEN (CASE WHEN regexp_matches(substr({_WORLD}, 2), '{rec.NANP}') THEN '1' END)"
    + "".join(f" WHEN regexp_matches({_WORLD}, '^{c}0?{lead}[0-9]{{{lo - 1},{hi - 1}}}$') THEN '{c}'" for c, lo, hi, lead in rec.PLANS)
    + " END)"
)
PLACEHOLDER = f"(regexp_matches(m, '^(?:[xX]*|[*]*|0*)$') OR {_words('m', rec.PLACEHOLDER_WORDS)} OR contains(m, '${{') OR contains(m, '{{{{') OR contains(m, '%('))"

# Base58Check in limbs of 96 bits: digits go in one by one, each limb hands on what is beyond it.
_LIMB = "79228162514264337593543950336::HUGEINT"
_T0 = "(acc[1] * 58 + x[1])"
_T1 = f"(acc[2] * 58 + {_T0} // {_LIMB})"
_T2 = f"(acc[3] * 58 + {_T1} // {_LIMB})"
_NONE = "0::HUGEINT, 0::HUGEINT, 0::HUGEINT"
_DIGIT = "strpos('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz', c) - 1"
_LIMBS = f"list_reduce(list_prepend([0::HUGEINT, {_NONE}], list_transform(string_split(m, ''), lambda c: [CAST({_DIGIT} AS HUGEINT), {_NONE}])), lambda acc, x: [{_T0} % {_LIMB}, {_T1} % {_LIMB}, {_T2} % {_LIMB}, acc[4] * 58 + {_T2} // {_LIMB}])"
_BYTES = "repeat('00', length(regexp_extract(m, '^1*'))) || regexp_replace(" + " || ".join(f"lpad(to_hex(limbs[{k}]), 24, '0')" for k in (4, 3, 2, 1)) + ", '^(00)+', '')"
_CHECKED = "length(bytes) >= 10 AND substr(sha256(unhex(sha256(unhex(left(bytes, length(bytes) - 8))))), 1, 8) = lower(right(bytes, 8))"


def _crypto_sql(docs: str) -> str:
    found = _spans(docs, rec.CRYPTO, 0, 0)
    spelt = "NOT regexp_matches(m, '[0l]')"
    checked = f"SELECT * FROM (SELECT *, {_BYTES} AS bytes FROM (SELECT *, {_LIMBS} AS limbs FROM ({found}) WHERE NOT starts_with(m, 'bc1') AND {spelt})) WHERE {_CHECKED}"
    return _row("'CRYPTO'", "0.5", "starts_with(m, 'bc1')", found) + " UNION ALL " + _row("'CRYPTO'", "1.0", "true", checked)


#: (entity, patterns, group, characters after the group, condition, type, score)
_CHECKS: dict[str, tuple] = {
    "EMAIL_ADDRESS": (EMAIL, 0, 0, "regexp_matches(regexp_extract(m, '[^.@]*$'), '[A-Za-z]') AND NOT regexp_matches(regexp_extract(m, '^(.*)@', 1), '[{}]')", 1.0),
    "CREDIT_CARD": (rec.CARD, 0, 0, f"NOT regexp_matches(prev, '[A-Za-z0-9._]') AND NOT regexp_matches(next, '[A-Za-z0-9._]') AND length({DIGITS}) BETWEEN 13 AND 19 AND len(list_distinct(string_split({DIGITS}, ''))) >= 4 AND {LUHN}", 1.0),
    "US_SSN": (rec.SSN, 0, 0, f"substr(m, 1, 3) NOT IN ('000', '666') AND NOT starts_with(m, '9') AND (contains(m, '-') OR {_words('line', rec.SSN_WORDS)})", 1.0),
    "IPV4": (rec.IPV4, 0, 0, f"NOT (prev = '.' AND regexp_matches(prev2, '[0-9]')) AND NOT (next = '.' AND regexp_matches(next2, '[0-9]')) AND NOT regexp_matches(m, {re2(rec.IPV4_NOT)}) AND NOT regexp_matches(line, {re2(rec.IPV4_LINE_NOT)})", 1.0),
    "IPV6": (rec.IPV6, 1, 0, f"NOT regexp_matches(next, '[:A-Za-z0-9_]') AND m NOT IN ({', '.join(map(literal, rec.LOCAL_IPV6))}) AND NOT regexp_matches(m, '^2001:(db8|DB8):')", 1.0),
    "URL": (URL, 0, 0, "NOT contains(m, '@') AND (starts_with(m, 'http') OR regexp_matches(m, '[/:]'))", 0.6),
    "IBAN_CODE": (rec.IBAN, 0, 0, MOD97, 1.0),
    "CRYPTO": (rec.CRYPTO, 0, 0, "true", 1.0),
    "US_DRIVER_LICENSE": (rec.LICENSE, 0, 0, "true", 0.5),
    "US_PASSPORT": (rec.PASSPORT, 0, 0, "true", 0.5),
    "SECRET_HEX_HIGH_ENTROPY": (rec.QUOTED_HEX, 1, 1, f"{ENTROPY} >= {rec.HEX_BITS}", 0.5),
    "SECRET_BASE64_HIGH_ENTROPY": (rec.QUOTED_BASE64, 1, 1, f"NOT regexp_matches(m, '^[0-9a-fA-F]+$') AND {ENTROPY} >= {rec.BASE64_BITS}", 0.5),
    "SECRET_JWT": (JWT, 0, 0, "true", 1.0),
    **{e: (p, 0, 0, "true", 1.0) for e, p, _ in rec.CREDENTIALS},
}


def _spans(docs: str, pattern: str, group: int, tail: int) -> str:
    """file, line, line_num, at (characters before), m, and the characters around."""
    p = re2(pattern)
    return f"""
SELECT *, substr(line, pos, 1) AS prev0, CASE WHEN pos >= 1 THEN substr(line, pos, 1) ELSE '' END AS prev, CASE WHEN pos >= 2 THEN substr(line, pos - 1, 1) ELSE '' END AS prev2,
  substr(line, pos + length(m) + 1, 1) AS next, substr(line, pos + length(m) + 2, 1) AS next2
FROM (SELECT file, line, line_num, {'g1[i]' if group else 'ms[i]'} AS m,
    CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)
      {f'+ length(ms[i]) - length(g1[i]) - {tail}' if group else ''} AS INT) AS pos
  FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i
    FROM (SELECT file, line, line_num, string_split_regex(line, {p}) AS gaps, regexp_extract_all(line, {p}) AS ms{f', regexp_extract_all(line, {p}, 1) AS g1' if group else ''}
      FROM (SELECT file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_num FROM ({docs}))
      WHERE regexp_matches(line, {p}))))"""


def _row(kind: str, score: str, where: str, spans: str) -> str:
    return f"""SELECT file, CAST(line_num AS INT) AS line_num, CAST(strlen(substr(line, 1, pos)) AS INT) AS col_start, CAST(strlen(substr(line, 1, pos)) + strlen(m) AS INT) AS col_end,
  {kind} AS entity_type, m AS text, CAST({score} AS FLOAT) AS score, line AS line_content FROM ({spans}) WHERE {where}"""


def entity_sql(entity: str, docs: str) -> str:
    """Findings of one recognizer as SQL; IP_ADDRESS goes by IPV4 and IPV6."""
    if entity == "PHONE_NUMBER":
        return _row(f"CASE WHEN {COUNTRY} = '1' THEN 'US_PHONE' ELSE 'INTL_PHONE' END", "1.0", f"{PHONE_SHAPE} AND {COUNTRY} IS NOT NULL", _spans(docs, rec.PHONE, 0, 0))
    if entity == "MAC_ADDRESS":
        return " UNION ALL ".join(_row("'MAC_ADDRESS'", "1.0", "true", _spans(docs, p, 0, 0)) for p in (rec.MAC, rec.MAC_DOTTED))
    if entity == "IP_ADDRESS":
        return " UNION ALL ".join(_row("'IP_ADDRESS'", "1.0", _CHECKS[v][3], _spans(docs, *_CHECKS[v][:3])) for v in ("IPV4", "IPV6"))
    if entity == "CRYPTO_CHECKED":
        return _crypto_sql(docs)
    if entity == "SECRET_KEYWORD_ASSIGNMENT":
        return _keyword_sql(docs)
    pattern, group, tail, where, score = _CHECKS[entity]
    return _row(f"'{entity}'", str(score), where, _spans(docs, pattern, group, tail))


def _keyword_sql(docs: str) -> str:
    """By line; the values in the texts at hand stand on the line of their names."""
    p = re2(KEYWORD)
    inner = f"""
SELECT file, line, line_num, CASE WHEN g1[i] <> '' THEN g1[i] ELSE g2[i] END AS m, g1[i] <> '' AS quoted,
    CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0)
      - length(CASE WHEN g1[i] <> '' THEN g1[i] ELSE g2[i] END) - CASE WHEN g1[i] <> '' THEN 1 ELSE 0 END AS INT) AS pos
FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i
  FROM (SELECT file, line, line_num, string_split_regex(line, {p}) AS gaps, regexp_extract_all(line, {p}) AS ms, regexp_extract_all(line, {p}, 1) AS g1, regexp_extract_all(line, {p}, 2) AS g2
    FROM (SELECT file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_num FROM ({docs}))
    WHERE regexp_matches(line, {p})))"""
    return _row("'SECRET_KEYWORD_ASSIGNMENT'", "0.4", f"NOT {PLACEHOLDER} AND (quoted OR substr(line, pos + length(m) + 1, 1) NOT IN ('.', '(', '[', '='))", inner)


def findings_sql(entities: tuple[str, ...], docs: str) -> str:
    """Of several recognizers, each place and type once with its highest score."""
    union = " UNION ALL ".join(f"({entity_sql(e, docs)})" for e in entities)
    return f"""SELECT file, line_num, col_start, col_end, entity_type, max(text) AS text, max(score) AS score, max(line_content) AS line_content
FROM ({union}) GROUP BY file, line_num, col_start, col_end, entity_type"""
