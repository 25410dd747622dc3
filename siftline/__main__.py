"""Command line: python -m siftline [options] [paths], or `format` and `migrate` for rules files."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from siftline.operators.suppress import RuleError
from siftline.operators.tagger import ZERO_SHOT_THRESHOLD, onnx_tagger, zero_shot_tagger
from siftline.plans.scan import Options, findings, scan, trace
from siftline.sinks import report
from siftline.sources import files
from siftline.sources import rules as rules_io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("siftline", description="Finds personal data and credentials in files.")
    p.add_argument("paths", nargs="*", help="files and folders; this folder where none is given")
    p.add_argument("--changed", metavar="FILE", help="scan only the paths that this file lists, one on a line")
    p.add_argument("--format", choices=("plain", "github", "tui"), default="plain", help="tui: lines around each finding")
    p.add_argument("--model", choices=("regex", "tagger", "regex+tagger"), default="regex")
    p.add_argument("--tagger", nargs=2, metavar=("MODEL", "TOKENIZER"), help="an ONNX token classifier and its tokenizer")
    p.add_argument("--zero-shot", metavar="MODULE:FUNCTION", help="instead of --tagger: a function that loads a zero-shot model, as zero_shot_tagger takes it")
    p.add_argument("--threshold", type=float, help="the least probability of a zero-shot model's tags; other taggers have fixed scores")
    p.add_argument("--debug", action="store_true", help="how many files and findings, and lines that a tagger failed on")
    p.add_argument("--entities", default="", help="only these types, comma-separated")
    p.add_argument("--baselines", help="rules file")
    p.add_argument("--fix-accept-all", action="store_true", help="make rules of all findings")
    p.add_argument("--only-issues", action="store_true")
    p.add_argument("--verbose", "-v", action="store_true", help="every candidate and what becomes of it")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        if argv[:1] == ["format"]:
            rules_io.format_rules(argv[1] if len(argv) > 1 else rules_io.rules_path())
            return 0
        if argv[:1] == ["migrate"]:
            source, target = (argv[1:] + [rules_io.DEFAULT_YAML, rules_io.DEFAULT_TOML][len(argv) - 1 :])[:2]
            print(f"{rules_io.migrate(source, target)} rules", file=sys.stderr)
            return 0
        return _scan(parser().parse_args(argv), spark)
    except (RuleError, OSError) as e:
        print(f"siftline: {e}", file=sys.stderr)
        return 2


def _tagger(a: argparse.Namespace, spark: SparkSession):
    if not a.zero_shot:
        return onnx_tagger(*a.tagger)
    module, _, function = a.zero_shot.partition(":")
    try:
        found = importlib.import_module(module)
        load = getattr(found, function)
    except (ImportError, AttributeError, ValueError) as e:
        raise RuleError(f"--zero-shot {a.zero_shot}: {e}") from e
    if getattr(found, "__file__", None) and not hasattr(found, "__path__") and "." not in module:
        spark.sparkContext.addPyFile(found.__file__)  # a single file goes along to the workers
    return zero_shot_tagger(load, threshold=ZERO_SHOT_THRESHOLD if a.threshold is None else a.threshold)


def _scan(a: argparse.Namespace, spark: SparkSession | None) -> int:
    path = rules_io.rules_path(a.baselines)
    rules = rules_io.load_rules(path)
    spark = spark or SparkSession.builder.appName("siftline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.changed:
        with open(a.changed, encoding="utf-8") as f:
            names = spark.createDataFrame([(x,) for x in f.read().splitlines() if x], "file string")
        docs = files.read_files(spark, [r["file"] for r in names.filter(files.is_scannable(names["file"])).collect()], rules)
    else:
        docs = files.source_tree(spark, a.paths, rules)
    context = report.CONTEXT_LINES if a.format == "tui" else None
    options = Options(context=context, entities=tuple(x for x in a.entities.split(",") if x), rules=rules, **({"recognizers": ()} if a.model == "tagger" else {}))
    if a.verbose:
        for r in trace(docs, options=options).toLocalIterator():
            print(f"[{r['tier']}] {r['file']}:{r['line_num']} {r['entity_type']} {r['text']!r}: {r['decision']}", file=sys.stderr)
    if a.model != "regex" and not (a.tagger or a.zero_shot):
        raise RuleError(f"--model {a.model} needs --tagger or --zero-shot")
    tagger = _tagger(a, spark) if a.model != "regex" else None
    outcomes = scan(docs, options=options, tagger=tagger, confirm=a.model == "regex+tagger").persist()  # scanned once
    lines = {"plain": report.plain_lines, "github": report.annotations, "tui": lambda f: report.diagnostics(f).select("value")}[a.format]
    if a.format != "github":
        for r in report.status_lines(outcomes, a.only_issues).orderBy("value").toLocalIterator():
            print(r["value"])
    for r in lines(findings(outcomes, context).orderBy("file", "line_num", "col_start", "col_end", "entity_type")).toLocalIterator():
        print(r["value"] + ("\n" if a.format == "tui" else ""))
    if a.debug:
        failed = outcomes.agg({"failed_lines": "sum"}).first()[0] or 0
        print(", ".join(f"{k}: {v}" for k, v in {**report.totals(outcomes).first().asDict(), "failed_lines": failed}.items()), file=sys.stderr)
    if a.fix_accept_all and (new := report.accept_all(findings(outcomes))):
        rules_io.save_rules(rules_io.merged(rules, new), path)
        print(f"ignored {len(new)} findings", file=sys.stderr)
    code = report.exit_code(outcomes)
    outcomes.unpersist()
    return code


if __name__ == "__main__":
    sys.exit(main())
