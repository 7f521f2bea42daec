"""Command line: detect, rules, protect, version."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    """0 if nothing at or above --fail-on was found, 1 if something was, 2 for errors."""
    p = argparse.ArgumentParser(prog="credsieve")
    sub = p.add_subparsers(dest="what", required=True)
    d = sub.add_parser("detect")
    d.add_argument("path")
    d.add_argument("--rules", action="append", default=[], help="file or folder of TOML rules")
    d.add_argument("--severity", default="medium")
    d.add_argument("--confidence", type=float, default=0.5)
    d.add_argument("--fail-on", default="high")
    d.add_argument("--format", choices=["table", "csv", "json", "sarif"], default="table")
    d.add_argument("--ignore", action="append", default=[])
    d.add_argument("--no-gitignore", action="store_true")
    d.add_argument("--baseline", metavar="FOLDER", help="only findings that the table there lacks are reported; it then has them")
    d.add_argument("--correlate", action="store_true", help="findings of a variable or value found under several paths weigh more")
    r = sub.add_parser("rules")
    r.add_argument("action", choices=["list", "show", "validate"])
    r.add_argument("name", nargs="?")
    r.add_argument("--category")
    g = sub.add_parser("protect")
    g.add_argument("action", choices=["install", "uninstall", "status"])
    g.add_argument("path", nargs="?", default=".")
    g.add_argument("--force", action="store_true")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.what == "version":
        print("credsieve 0.1.0")
        return 0
    if a.what == "protect":
        return protect(a.action, Path(a.path), a.force)
    from pyspark.sql import functions as F

    from .operators import findings, match, report
    from .operators import rules as rule_ops

    if a.what == "rules" and a.action == "validate":
        good, bad = rule_ops.parse_rules(Path(a.name).read_text(encoding="utf-8"))
        print(f"{len(good)} rules", *bad, sep="\n")
        return 2 if bad else 0
    from .session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.what == "rules":
        table = rule_ops.list_rules(rule_ops.load_rules(spark), a.category)
        for row in (table.where(f"id = '{a.name}'") if a.action == "show" else table.select("id", "severity", "category", "description")).collect():
            print(*(f"{k}: {v}" for k, v in row.asDict().items() if v), sep="\n" if a.action == "show" else "  ")
        return 0
    from .sources.files import directory

    rules = rule_ops.load_rules(spark, *(text for f in a.rules for text in rule_ops.rule_texts(f)))
    files = directory(spark, a.path, a.ignore, gitignore=False if a.no_gitignore else None).select(F.col("path").alias("fragment"), "path", "text")
    hits = match.match_all(files, rules, "fragment", "text", "path")
    found, held = findings.dedup_best(findings.score_matches(hits, rules, threshold=a.confidence)), []
    if a.correlate:
        held.append(found := found.persist())
        by_variable = findings.variable_chains(found)
        chains = by_variable.drop("hashes").unionByName(findings.value_chains(found, by_variable))
        found = findings.apply_chains(found, chains)
    found = findings.least_severity(found, a.severity)
    if a.baseline:
        found = findings.new_findings(found, known(spark, a.baseline))
    held.append(found := findings.in_order(found).persist())
    if a.format == "csv":
        print(report.CSV_HEADER)
    shown = {"csv": report.csv_lines, "json": report.json_report, "sarif": report.sarif_report, "table": report.table_rows}[a.format](found)
    for row in shown.toLocalIterator():
        print(*(x for x in row if x is not None), sep="  ")
    code = findings.exit_code(found, a.fail_on)
    if a.baseline:
        # After the report, so that findings of a run that failed are reported again.
        found.select("finding_hash").distinct().write.mode("append").parquet(a.baseline)
    # A later run over the same folder in the same session must not be given these rows.
    for table in held:
        table.unpersist()
    return code


def known(spark, path: str):
    """The hashes of findings in a baseline; none if there is no such table yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema("finding_hash string").parquet(path)
    return spark.createDataFrame([], "finding_hash string")


MARK = "# credsieve: staged files are searched for credentials"
HOOK = f"""#!/bin/sh
{MARK}
staged=$(mktemp -d) || exit 1
trap 'rm -rf "$staged"' EXIT
git diff --cached --name-only --diff-filter=ACMR -z | git checkout-index --prefix="$staged/" -z --stdin
python -m credsieve detect --no-gitignore "$staged"
"""


def protect(action: str, path: Path, force: bool) -> int:
    """Installs, removes or reports the hook that searches staged files before a commit; a hook that is not ours stays, but by force."""
    repository = next((p / ".git" for p in [path.resolve(), *path.resolve().parents] if (p / ".git").is_dir()), None)
    if repository is None:
        print("not in a repository", file=sys.stderr)
        return 2
    hook = repository / "hooks" / "pre-commit"
    ours = hook.exists() and MARK in hook.read_text(encoding="utf-8", errors="replace")
    if action == "status":
        print("installed" if ours else "another hook" if hook.exists() else "not installed")
        return 0 if ours else 1
    if hook.exists() and not ours and not force:
        print(f"{hook} is another hook; --force replaces or removes it", file=sys.stderr)
        return 2
    if action == "install":
        hook.parent.mkdir(exist_ok=True)
        hook.write_text(HOOK, encoding="utf-8")
        hook.chmod(0o755)
    else:
        hook.unlink(missing_ok=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
