"""Suppression rules: which findings, and which files, a rule set silences."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from functools import cache, reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import text as t

GLOBAL, FILE, LINE = "global", "file", "line"
_GLOB = re.compile(r"[*?\[]")


class RuleError(ValueError):
    """A rule that can't be used."""


@dataclass(frozen=True)
class Rule:
    """A rule as written in a file. type "file" skips whole files; text and match are alternatives."""

    type: str | None = None
    entity_type: str | None = None
    scope: str | None = None
    path: str | None = None
    line: str | None = None
    text: str | None = None
    ignorecase: bool | None = None
    textglob: bool | None = None
    match: str | None = None

    @property
    def inferred_scope(self) -> str:
        return LINE if self.line is not None else FILE if self.path is not None else GLOBAL

    @property
    def effective_scope(self) -> str:
        return self.scope if self.scope in (GLOBAL, FILE, LINE) else self.inferred_scope

    @property
    def sort_key(self) -> tuple:
        rank = (GLOBAL, FILE, LINE).index(self.effective_scope)
        return (0 if self.type == "file" else 1, self.entity_type or "", rank, self.path or "", self.match if self.match is not None else self.text or "")


def parse_lines(spec: str) -> list[tuple[int, int]]:
    """Inclusive ranges of "1,5,8..29"."""
    out = []
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        ends = [x.strip() for x in part.split("..", 1)]
        if not all(re.fullmatch(r"\+?[0-9]+", x) and int(x) < 2**32 for x in ends):
            raise RuleError(f"no line number in `{part}` of `{spec}`")
        lo, hi = int(ends[0]), int(ends[-1])
        if lo > hi:
            raise RuleError(f"a range that ends before it starts: `{part}`")
        out.append((lo, hi))
    if not out:
        raise RuleError(f"no lines in `{spec}`")
    return out


def normal_path(path: str) -> str:
    return path[2:] if path.startswith(("./", ".\\")) else path


def _normal(path: Column) -> Column:
    return F.regexp_replace(path, r"^\.[/\\]", "")


def _glob(s: str) -> str | None:
    return t.glob_to_regex(s) if _GLOB.search(s) else None


@dataclass(frozen=True)
class Rules:
    """A rule set and flags by entity type (False, True or a least score)."""

    rules: tuple[Rule, ...] = ()
    flags: dict[str, bool | float] = field(default_factory=dict)

    def __post_init__(self):
        for r in self.rules:
            if r.text is not None and r.match is not None:
                raise RuleError("a rule sets both `text` and `match`")
            if r.line is not None:
                parse_lines(r.line)
            if r.match is not None and not _compiles(r):
                warnings.warn(f"a rule's pattern can't be read, the rule is left out: {r.match}", stacklevel=2)
            if r == Rule():
                warnings.warn("a rule without fields suppresses everything", stacklevel=2)

    @property
    def matchers(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.type != "file" and (r.match is None or _compiles(r)))

    @property
    def file_rules(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.type == "file" and r.path is not None)


_POSIX = re.compile(r"\[:(\^?)(alnum|alpha|ascii|blank|cntrl|digit|graph|lower|print|punct|space|upper|word|xdigit):\]")


@cache
def java_pattern(pattern: str) -> str | None:
    """A rule's pattern as Spark runs it; null where it is none, or uses what rules don't know: look-around and back references.

    Named groups and POSIX classes are written as Java has them; Java itself compiles the result.
    """
    bare = re.sub(r"\\.", "", pattern, flags=re.S)
    if re.search(r"\(\?(?:[=!>]|<[=!])", bare) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        return None
    posix = {"ascii": "ASCII", "xdigit": "XDigit"}

    def named(m: re.Match) -> str:
        if m[2] == "word":
            return "\\W" if m[1] else "\\w"
        return f"\\{'P' if m[1] else 'p'}{{{posix.get(m[2], m[2].capitalize())}}}"

    out = _POSIX.sub(named, pattern.replace("(?P<", "(?<"))
    jvm = SparkContext.getOrCreate()._jvm
    try:
        jvm.java.util.regex.Pattern.compile("(?U)" + out)
    except (Py4JJavaError, IllegalArgumentException):
        return None
    return out


def _compiles(r: Rule) -> bool:
    return java_pattern(r.match or "") is not None


def is_file_skipped(file: Column, rules: Rules) -> Column:
    if not rules.file_rules:
        return F.lit(False)
    path = _normal(file)
    literal = sorted({normal_path(r.path) for r in rules.file_rules if _glob(normal_path(r.path)) is None})
    globs = sorted({g for r in rules.file_rules if (g := _glob(normal_path(r.path)))})
    out = path.isin(*literal) if literal else F.lit(False)
    for g in globs:
        out = out | path.rlike(g)
    return F.coalesce(out, F.lit(False))


def _is_plain(r: Rule) -> bool:
    """Names a type and a text that stands for itself, in any case."""
    if r.match is not None or r.text is None or r.entity_type is None or r.ignorecase is False:
        return False
    wild = r.textglob is not False and _GLOB.search(r.text)
    return not wild and not r.text.startswith(("@", "*.")) and not r.text.endswith("@")


def is_suppressed(file: Column, f: Column, rules: Rules) -> Column:
    """Whether any rule matches the finding f (struct) of a file. Rules become part of the plan.

    Plain rules, as made from findings by the thousand, are one set for each scope, looked up by type, place and text.
    """
    known: dict[str, set[str]] = {GLOBAL: set(), FILE: set()}
    rest = []
    for r in rules.matchers:
        literal_path = r.path is not None and _glob(normal_path(r.path)) is None
        if _is_plain(r) and r.effective_scope == GLOBAL:
            known[GLOBAL].add("\0".join((r.entity_type, _lower(r.text))))
        elif _is_plain(r) and r.effective_scope == FILE and literal_path:
            known[FILE].add("\0".join((r.entity_type, normal_path(r.path), _lower(r.text))))
        else:
            rest.append(r)
    text = t.lower_ascii(f["text"])
    keys = {GLOBAL: F.concat_ws("\0", f["entity_type"], text), FILE: F.concat_ws("\0", f["entity_type"], _normal(file), text)}
    parts = [keys[scope].isin(*sorted(v)) for scope, v in known.items() if v]
    parts += [_matches(file, f, r) for r in rest]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False)) if parts else F.lit(False)


def _matches(file: Column, f: Column, r: Rule) -> Column:
    out = text_matches(f, r)
    if r.entity_type is not None:
        out = (f["entity_type"] == r.entity_type) & out
    if r.effective_scope == GLOBAL:
        return out
    if r.path is None:
        return F.lit(False)
    glob = _glob(normal_path(r.path))
    out = out & (_normal(file).rlike(glob) if glob else _normal(file) == normal_path(r.path))
    if r.effective_scope == LINE:
        if r.line is None:
            return F.lit(False)
        out = out & reduce(lambda a, b: a | b, (f["line_num"].between(lo, hi) for lo, hi in parse_lines(r.line)))
    return out


def _lower(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def text_matches(f: Column, r: Rule) -> Column:
    """Pattern before glob before plain text; what a rule leaves open matches all."""
    fold = r.ignorecase is not False
    if r.match is not None:
        return f["text"].rlike(("(?Ui)" if fold else "(?U)") + java_pattern(r.match))
    if r.text is None:
        return F.lit(True)
    target = t.lower_ascii(f["text"]) if fold else f["text"]
    glob = _glob(_lower(r.text) if fold else r.text) if r.textglob is not False else None
    out = target.rlike(glob) if glob else target == (_lower(r.text) if fold else r.text)
    return out | _email_rule(f, r.text, glob is not None) | _url_rule(f, r.text)


def _email_rule(f: Column, text: str, is_glob: bool) -> Column:
    """`@host` by domain, with wildcards or as an ending; `user@` by the start."""
    text = _lower(text)
    mail = t.lower_ascii(f["text"])
    out = F.lit(False)
    if text.startswith("@"):
        host = text[1:]
        if _GLOB.search(host):
            regex = t.glob_to_regex(host)
            out = F.substring_index(mail, "@", -1).rlike(regex) & F.contains(mail, F.lit("@")) if regex else out
        elif not is_glob:
            out = F.contains(mail, F.lit("@")) & mail.endswith(text)
    if text.endswith("@") and not is_glob:
        out = out | mail.startswith(text)
    return (f["entity_type"] == "EMAIL_ADDRESS") & out


def _url_rule(f: Column, text: str) -> Column:
    """`*.host` matches the host and its subdomains."""
    if not text.startswith("*.") or len(text) < 3:
        return F.lit(False)
    suffix, host = _lower(text[2:]), t.url_host(f["text"])
    return (f["entity_type"] == "URL") & F.coalesce((host == suffix) | host.endswith("." + suffix), F.lit(False))
