"""Column functions on text: matches with their places, checksums, entropy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.schema import FOUND, MATCH, MATCH_FIELDS

#: Matches whose places are summed one after another; sums of such runs are then summed in turn.
RUN = 64
#: Marks around a match and between its groups.
EDGE, INNER = "\x01", "\x02"


def bind(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def matches(text: Column, pattern: str | Column, row: Callable[[dict[str, Column]], dict[str, Column]], groups: int = 0, around: bool = False) -> Column:
    """All matches, left to right without overlap, as array<MATCH>: what `located` makes findings of.

    row: of a match (m, g1, g2, ..; with around `pre` and `post`, up to two characters on either side), the fields
    entity_type, score, and where they differ from the whole match, found with score 1 on any line: text (empty: no
    finding), tail (characters of the match after the text) and line_rule.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    names = ["gaps", "ms", *(f"g{k}" for k in range(1, groups + 1))]
    each = [F.split(text, pattern, F.lit(-1)), *(F.regexp_extract_all(text, pattern, F.lit(k)) for k in range(groups + 1))]
    # One run of the pattern marks matches and groups; a text that holds a mark itself is matched once for each of them.
    marked = F.regexp_replace(text, pattern, F.lit(EDGE + INNER.join(f"${k}" for k in range(groups + 1)) + EDGE))

    def unmarked(pieces: Column) -> Column:
        odd = F.filter(pieces, lambda x, i: i % 2 == 1)
        gaps = F.filter(pieces, lambda x, i: i % 2 == 0)
        if not groups:
            return F.struct(gaps.alias("gaps"), odd.alias("ms"))
        return bind(F.transform(odd, lambda x: F.split(x, INNER, -1)), lambda fs: F.struct(gaps.alias("gaps"), *(F.transform(fs, lambda f: F.get(f, F.lit(k))).alias(n) for k, n in enumerate(names[1:]))))  # noqa: B023

    clean = ~F.contains(text, F.lit(EDGE)) & ~F.contains(text, F.lit(INNER))
    parts = F.when(clean, bind(F.split(marked, EDGE, -1), unmarked)).otherwise(F.struct(*(c.alias(n) for c, n in zip(each, names, strict=True))))

    def match(p: Column, m: Column, i: Column) -> Column:
        x = {"m": m} | {f"g{k}": F.get(p[f"g{k}"], i) for k in range(1, groups + 1)}
        if not around:
            return made(p, x, i)
        pre = F.right(F.concat(F.right(F.coalesce(F.get(p["ms"], i - 1), F.lit("")), F.lit(2)), F.right(F.get(p["gaps"], i), F.lit(2))), F.lit(2))
        post = F.substring(F.concat(F.substring(F.get(p["gaps"], i + 1), 1, 2), F.substring(F.coalesce(F.get(p["ms"], i + 1), F.lit("")), 1, 2)), 1, 2)
        return bind(F.struct(pre.alias("pre"), post.alias("post")), lambda o: made(p, x | {"pre": o["pre"], "post": o["post"]}, i))

    def made(p: Column, x: dict[str, Column], i: Column) -> Column:
        head, rest, got = F.get(p["gaps"], i), x["m"], row(x)
        if "tail" in got:
            lead = F.greatest(F.lit(0), F.length(x["m"]) - F.length(got["text"]) - got["tail"])
            head, rest = F.concat(head, F.left(x["m"], lead)), F.substring(x["m"], lead + 1, F.length(x["m"]))
        first = i == 0
        fields = (first, head, rest, got.get("text", x["m"]), got["entity_type"], got["score"].cast("float"), got.get("line_rule", F.lit(0)))
        return F.struct(*(c.alias(n) for c, (n, _) in zip(fields, MATCH_FIELDS, strict=True)))

    return bind(parts, lambda p: F.transform(p["ms"], lambda m, i: match(p, m, i)))


def matches_of(text: Column, patterns: list[tuple[str, str, float, tuple[str, ...]]]) -> Column:
    """Whole matches of several patterns (entity, pattern, score, words), each tried only on a text with one of its words.

    One expression over a table of patterns: a plan with dozens of them takes longer to make than many texts to scan.
    """
    rows = [F.struct(F.lit(e).alias("e"), F.lit(p).alias("p"), F.lit(s).cast("float").alias("s"), F.array(*map(F.lit, ws)).alias("ws")) for e, p, s, ws in patterns]
    tried = F.filter(F.array(*rows), lambda r: F.exists(r["ws"], lambda w: F.contains(text, w)))
    return F.flatten(F.transform(tried, lambda r: matches(text, r["p"], lambda x: {"entity_type": r["e"], "score": r["s"]})))


def no_matches() -> Column:
    return F.array().cast(f"array<{MATCH}>")


def before(x: dict[str, Column], back: int = 1) -> Column:
    """The character that stands `back` (1 or 2) places before a match, or an empty string."""
    return F.right(x["pre"], F.lit(1)) if back == 1 else F.when(F.length(x["pre"]) == 2, F.left(x["pre"], F.lit(1))).otherwise(F.lit(""))


def after(x: dict[str, Column], on: int = 1) -> Column:
    """The character `on` (1 or 2) places after a match's end, or an empty string."""
    return F.substring(x["post"], on, 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_feeds(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _after_last(c: Column) -> Column:
    """Bytes after the last line feed."""
    return F.octet_length(F.substring_index(c, "\n", -1))


def _moved(at: Column, down: Column, on: Column) -> tuple[Column, Column]:
    return at["line"] + down, F.when(down > 0, on).otherwise(at["col"] + on)


def located(text: Column, found: Column, line_rules: tuple[Callable[[Column], Column], ...] = ()) -> Column:
    """Findings of matches (array<FOUND>): lines from 1, columns in bytes from 0; a match over lines ends beyond its first.

    found holds the matches of one or several patterns, those of each in order; the first of a pattern is marked. Line
    feeds, and bytes since the last one, are summed up to each match, by runs of matches and then over runs, so that the
    work grows with text and matches alone. A match with a line_rule of k is a finding where the k-th of line_rules holds
    for its line; lines are judged once. Findings don't hold their lines: many on a long one would fill the memory.
    """
    fields = ("text", "entity_type", "score", "line_rule")

    def sized(x: Column) -> Column:
        sizes = (_line_feeds(x["head"]).alias("down"), _after_last(x["head"]).alias("on"), _line_feeds(x["rest"]).alias("down2"), _after_last(x["rest"]).alias("on2"))
        return F.struct(x["first"], *sizes, *(x[n] for n in fields))

    def walk(run: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            origin = F.when(x["first"], F.struct(F.lit(1).alias("line"), F.lit(0).alias("col"))).otherwise(F.struct(acc["line"], acc["col"]))
            fixed = acc["fixed"] | x["first"]

            def there(at: Column) -> Column:
                line, col = _moved(at, x["down"], x["on"])
                return F.struct(line.alias("line"), col.alias("col"))

            def done(at: Column) -> Column:
                line, col = _moved(at, x["down2"], x["on2"])
                row = F.struct(fixed.alias("fixed"), at["line"], at["col"])
                return F.struct(line.alias("line"), col.alias("col"), fixed.alias("fixed"), F.concat(acc["out"], F.array(row)).alias("out"))

            return bind(bind(origin, there), done)

        # Each step copies what it has so far, so that this is numbers alone; texts join them afterwards.
        none = F.array().cast("array<struct<fixed:boolean,line:int,col:int>>")
        sums = F.aggregate(run, F.struct(F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(False).alias("fixed"), none.alias("out")), step)

        def with_texts(acc: Column) -> Column:
            rows = F.transform(run, lambda x, i: bind(F.get(acc["out"], i), lambda at: F.struct(at["fixed"], at["line"], at["col"], *(x[n] for n in fields))))
            return F.struct(acc["line"], acc["col"], acc["fixed"], F.filter(rows, lambda r: r["text"] != "").alias("out"))

        return bind(sums, with_texts)

    def start(acc: Column, w: Column) -> Column:
        line, col = _moved(acc, w["line"], w["col"])
        here = F.array(F.struct(acc["line"].alias("line"), acc["col"].alias("col")))
        return F.struct(F.when(w["fixed"], w["line"]).otherwise(line).alias("line"), F.when(w["fixed"], w["col"]).otherwise(col).alias("col"), F.concat(acc["starts"], here).alias("starts"))

    def placed(s: Column, r: Column) -> Column:
        line, col = _moved(s, r["line"], r["col"])
        return F.struct(F.when(r["fixed"], r["line"]).otherwise(line).alias("line_num"), F.when(r["fixed"], r["col"]).otherwise(col).alias("col_start"), *(r[n] for n in fields))

    def over(ms: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), ((F.size(ms) - 1) / RUN).cast("int")), lambda k: bind(F.transform(F.slice(ms, k * RUN + 1, F.lit(RUN)), sized), walk))
        nowhere = F.struct(F.lit(1).alias("line"), F.lit(0).alias("col"), F.array().cast("array<struct<line:int,col:int>>").alias("starts"))
        both = bind(runs, lambda ws: F.struct(ws.alias("runs"), F.aggregate(ws, nowhere, start, lambda acc: acc["starts"]).alias("starts")))
        return bind(both, lambda b: F.flatten(F.transform(b["runs"], lambda w, k: F.transform(w["out"], lambda r: placed(F.get(b["starts"], k), r)))))

    def full(f: Column) -> Column:
        return F.struct(f["line_num"], f["col_start"], (f["col_start"] + F.octet_length(f["text"])).alias("col_end"), f["entity_type"], f["text"], f["score"])

    def judged(fs: Column) -> Column:
        if not line_rules:
            return fs
        flags = lambda ls: [F.when(F.exists(fs, lambda f: f["line_rule"] == k), F.transform(ls, rule)).alias(f"r{k}") for k, rule in enumerate(line_rules, 1)]  # noqa: B023, E731
        holds = lambda r, f: reduce(lambda out, k: out.when(f["line_rule"] == k, F.get(r[f"r{k}"], f["line_num"] - 1)), range(2, len(line_rules) + 1), F.when(f["line_rule"] == 1, F.get(r["r1"], f["line_num"] - 1))).otherwise(True)
        kept = lambda ls: bind(F.struct(*flags(ls)), lambda r: F.filter(fs, lambda f: holds(r, f)))
        return F.when(F.exists(fs, lambda f: f["line_rule"] > 0), bind(lines(text), kept)).otherwise(fs)

    return bind(found, lambda ms: F.when(F.size(ms) > 0, bind(over(ms), lambda fs: F.transform(judged(fs), full))).otherwise(no_findings()))


def no_findings() -> Column:
    return F.array().cast(f"array<{FOUND}>")


def lines_at(text: Column, numbers: Column) -> Column:
    """The lines of a text up to the last of `numbers` (sorted, each once), null but for these: line n is item n - 1."""

    def from_last(ls: Column, at: Column) -> Column:
        gap = lambda n, k: F.array_repeat(F.lit(None).cast("string"), n - F.coalesce(F.get(at, k - 1), F.lit(0)) - 1)
        return F.flatten(F.transform(at, lambda n, k: F.concat(gap(n, k), F.array(F.get(ls, n - 1)))))

    return bind(F.struct(lines(text).alias("lines"), numbers.alias("at")), lambda x: from_last(x["lines"], x["at"]))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    if len(words) < 4:
        return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
    return bind(c, lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def distinct_characters(c: Column) -> Column:
    return F.size(F.array_distinct(characters(c)))


def mod97_is_one(c: Column) -> Column:
    """ISO 13616: the first four characters go to the end, letters count 10 to 35, the number modulo 97 is 1."""
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        v = F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(F.upper(ch)) - 55)
        return ((acc * F.when(v >= 10, 100).otherwise(10) + v) % 97).cast("int")

    return c.rlike("^[0-9A-Za-z]+$") & (F.aggregate(characters(turned), F.lit(0), step) == 1)


def shannon_entropy(c: Column) -> Column:
    """Bits per character; 0 for an empty string."""

    def bits(s: Column) -> Column:
        share = lambda x: (F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(s)
        return F.aggregate(F.array_distinct(characters(s)), F.lit(0).cast("double"), lambda acc, x: acc - share(x) * F.log2(share(x)))

    return bind(c, bits)


def url_host(c: Column) -> Column:
    """Host of a URL or bare host, in lower case without trailing dots; null where there is none."""
    rest = F.when(F.contains(c, F.lit("://")), F.substring(c, F.instr(c, "://") + 3, F.length(c))).otherwise(c)
    host = F.regexp_extract(F.substring_index(rest, "@", -1), r"^[^/?#:]*", 0)
    return F.when(host != "", lower_ascii(F.regexp_replace(host, r"\.+$", "")))


def glob_to_regex(pattern: str) -> str | None:
    """An anchored regex for a glob, in which `*` crosses slashes; null where it is no valid glob.

    `?` is one character, `[..]` a set, `[!..]` its opposite. `**` must be a whole path component, and matches any
    number of components, none included.
    """
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            if j - i > 2:
                return None
            if j - i == 2:
                whole = (i == 0 or pattern[i - 1] == "/") and (j == n or pattern[j] == "/")
                if not whole:
                    return None
                if j == n:
                    out.append(".*")
                else:
                    out.append("(?:.*/)?")
                    j += 1
            else:
                out.append(".*")
            i = j
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            start = i + 2 if i + 1 < n and pattern[i + 1] == "!" else i + 1
            end = pattern.find("]", start + 1)
            if end < 0:
                return None
            inner = "".join(f"\\{x}" if x in "\\[]^&~|" else x for x in pattern[start:end])
            inner = inner if not inner.startswith("-") else "\\" + inner
            out.append(f"[{'^' if start == i + 2 else ''}{inner}]")
            i = end + 1
        else:
            out.append(quote(c))
            i += 1
    return "(?s)^" + "".join(out) + "\\z"


def quote(s: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}-&~#/" else c for c in s)
