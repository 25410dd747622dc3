"""Row shapes."""

from __future__ import annotations

#: A match: first: of its pattern in this text; head: what stands between the match before and the found text; rest: the
#: match from there on; line_rule: 0, or the number of the rule that its line has to obey.
MATCH_FIELDS = (
    ("first", "boolean"),
    ("head", "string"),
    ("rest", "string"),
    ("text", "string"),
    ("entity_type", "string"),
    ("score", "float"),
    ("line_rule", "int"),
)
MATCH = "struct<" + ",".join(f"{n}:{t}" for n, t in MATCH_FIELDS) + ">"
FINDING_FIELDS = (
    ("line_num", "int"),
    ("col_start", "int"),
    ("col_end", "int"),
    ("entity_type", "string"),
    ("text", "string"),
    ("score", "float"),
    ("line_content", "string"),
)
#: A finding in its row: without its line, which stands in the row once, however many findings it has.
FOUND_COLUMNS = [n for n, _ in FINDING_FIELDS[:-1]]
FOUND = "struct<" + ",".join(f"{n}:{t}" for n, t in FINDING_FIELDS[:-1]) + ">"
FINDING_COLUMNS = ["file", *(n for n, _ in FINDING_FIELDS)]
FINDINGS = "file string, " + ", ".join(f"{n} {t}" for n, t in FINDING_FIELDS)

#: A suppression rule as read from a rules file; all fields may be missing.
RULE_FIELDS = ("type", "entity_type", "scope", "path", "line", "text", "ignorecase", "textglob", "match")
