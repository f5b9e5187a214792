"""``python -m plumbline.cli PATH``: analyzers over a source tree."""

from __future__ import annotations

import argparse
import sys
from contextlib import nullcontext
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import analyzers as an
from .plans import detect, reports
from .plans.views import Views
from .shipping import ship
from .sources import sinks, tree


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("path")
    parser.add_argument("--only", action="append", help="an analyzer's name; may be given again")
    parser.add_argument("--stack", help="default file and folder rules of a stack")
    parser.add_argument("--preset", help="content rules; both are found from manifests where not given")
    parser.add_argument("--rules", help="a TOML file with rules, in place of stack and preset")
    parser.add_argument("--diff", help="a unified diff, for change impact")
    parser.add_argument("--analyzer", action="append", default=[], help="dotted name of a further analyzer")
    parser.add_argument("--base", help="a commit to compare the work tree with, for change impact")
    parser.add_argument("--staged", action="store_true", help="change impact of what is staged")
    parser.add_argument("--json", action="store_true", help="every issue as one JSON document")
    parser.add_argument("-o", "--output", help="a file for the JSON document, in place of the terminal")
    parser.add_argument("--tables", help="a folder, in any store, for every analyzer's issues as JSON lines")
    parser.add_argument("--rows", type=int, default=20, help="issues of each analyzer on the terminal; 0 for all")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    ship(spark)
    views = Views.scan(spark, args.path)
    stack, preset = args.stack or detect.default_stack(args.path), args.preset or detect.default_preset(args.path)
    chosen = an.default_analyzers(stack, preset)
    if args.rules:
        rules = tree.load_rules(args.rules)
        own = [an.Taxonomy(tuple(rules["taxonomy"])), an.FolderStructure(tuple(rules["folders"])), an.RepoRules(tuple(rules["content"]))]
        names = {a.name for a in own}
        chosen = [a for a in chosen if a.name not in names] + own
    if args.diff or args.base or args.staged:
        if args.diff:
            diff = spark.createDataFrame([(0, Path(args.diff).read_text(encoding="utf-8"))], "diff_id int, text string")
        else:
            diff = tree.git_diff(spark, args.path, None if args.staged else args.base)
        chosen.append(an.BlastRadius(tree.parse_diff(diff)))
    chosen += [an.load_analyzer(name) for name in args.analyzer]
    results = an.run(views, chosen, args.only)
    if args.tables:
        sinks.write_tables(results, args.tables)
    if args.json or args.output:
        with open(args.output, "w", encoding="utf-8") if args.output else nullcontext(sys.stdout) as out:
            sinks.write_report(results, out)
        return 0
    for name, result in results.items():
        print(f"{name}: {result.summary.first()[0]}")
        issues = reports.in_order(name, result.issues)
        shown = 0
        for row in issues.toLocalIterator() if not args.rows else issues.limit(args.rows + 1).toLocalIterator():
            if args.rows and shown == args.rows:
                print(f"  ... more than {args.rows}; --rows 0 shows all")
                break
            print("  " + "  ".join(str(v) for v in row if v is not None))
            shown += 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
