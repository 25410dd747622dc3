"""Rule files: TOML, and an older YAML form that is read only."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Iterable

from siftline.operators.suppress import Rule, RuleError, Rules
from siftline.schema import RULE_FIELDS

ALIASES = {"file": "path", "pattern": "match"}
DEFAULT_TOML, DEFAULT_YAML = ".baselines/phi.toml", ".baselines/phi.yaml"


def rules_path(explicit: str | None = None, folder: str = ".") -> str:
    """An explicit path, else the TOML file if it is there, else the YAML file if it is there, else the TOML file's path."""
    if explicit:
        return explicit
    toml, yaml = os.path.join(folder, DEFAULT_TOML), os.path.join(folder, DEFAULT_YAML)
    return yaml if not os.path.exists(toml) and os.path.exists(yaml) else toml


def load_rules(path: str) -> Rules:
    """No file, no rules. A field that isn't known is an error."""
    if not os.path.exists(path):
        return Rules()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return parse_yaml(text) if path.endswith((".yaml", ".yml")) else parse_toml(text)


def parse_toml(text: str) -> Rules:
    data = tomllib.loads(text)
    if extra := set(data) - {"entities", "ignored"}:
        raise RuleError(f"unknown: {', '.join(sorted(extra))}")
    flags: dict[str, bool | float] = {}
    for name, v in data.get("entities", {}).items():
        if not isinstance(v, (bool, int, float)):
            raise RuleError(f"{name} must be true, false or a score")
        flags[name] = v if isinstance(v, bool) else float(v)
    return Rules(tuple(_rule(row) for row in data.get("ignored", [])), flags)


def _rule(row: dict) -> Rule:
    out: dict = {}
    for k, v in row.items():
        name = ALIASES.get(k, k)
        if name not in RULE_FIELDS:
            raise RuleError(f"unknown field `{k}`")
        if name in out:
            raise RuleError(f"`{name}` is given twice")
        if not isinstance(v, bool if name in ("ignorecase", "textglob") else str):
            raise RuleError(f"`{k}` has a value of the wrong type")
        out[name] = v
    return Rule(**out)


def parse_yaml(text: str) -> Rules:
    """A map `ignored` from any key to a rule; the key is the path of a whole-file rule that names none."""
    import yaml

    rows = (yaml.safe_load(text) or {}).get("ignored") or {}
    out = []
    for key in sorted(rows, key=str):
        e = rows[key] or {}
        line = e.get("line")
        line = line if isinstance(line, str) else str(line) if isinstance(line, (int, float)) and not isinstance(line, bool) else None
        path = e.get("file") or (str(key) if e.get("type") == "file" else None)
        out.append(Rule(type=e.get("type"), scope=e.get("scope"), path=path, line=line, entity_type=e.get("entity_type"), text=e.get("text")))
    return Rules(tuple(out))


def to_toml(rules: Rules) -> str:
    """Sorted; a scope that would be inferred is left out; types are set apart by a blank line more."""
    parts = []
    if rules.flags:
        parts.append("[entities]\n" + "".join(f"{_key(k)} = {_value(v)}\n" for k, v in sorted(rules.flags.items())))
    previous = None
    for r in sorted(rules.rules, key=lambda r: r.sort_key):
        header = r.entity_type or r.type
        gap = "\n" if previous is not None and header is not None and header != previous else ""
        fields = [(n, getattr(r, n)) for n in RULE_FIELDS]
        kept = [(n, v) for n, v in fields if v is not None and not (n == "scope" and r.effective_scope == r.inferred_scope)]
        parts.append(gap + "[[ignored]]\n" + "".join(f"{n} = {_value(v)}\n" for n, v in kept))
        previous = header if header is not None else previous
    return "\n".join(parts)


def _key(k: str) -> str:
    return k if k.replace("_", "").replace("-", "").isalnum() and k.isascii() else json.dumps(k)


def _value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f") if isinstance(v, str) else repr(float(v))


def save_rules(rules: Rules, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_toml(rules))


def format_rules(path: str) -> None:
    """Loads and saves again, sorted."""
    save_rules(load_rules(path), path)


def migrate(source: str, target: str) -> int:
    """YAML to TOML; the number of rules."""
    with open(source, encoding="utf-8") as f:
        rules = parse_yaml(f.read())
    save_rules(rules, target)
    return len(rules.rules)


def merged(rules: Rules, more: Iterable[Rule]) -> Rules:
    """New rules after the old, each once."""
    return Rules(tuple(dict.fromkeys([*rules.rules, *more])), rules.flags)
