"""Command line: ``python -m answerloom.plans.cli --config settings.json --input file``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.ingest import with_row_ids
from ..operators.quality import summary_line
from ..session import session
from ..sources.config import Config
from ..sources.sinks import write_tables, write_workbook
from ..sources.state import load_json, save_json
from ..sources.tables import read_table
from .curation import EditError, Edits, edited, overrides
from .pipeline import run, suggest_count


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="answerloom", description="Finds and rates the themes of open-ended answers.")
    p.add_argument("--config")
    p.add_argument("--input", required=True)
    p.add_argument("--run-dir", default="runs/auto")
    p.add_argument("--until", default="result", choices=["ingest", "segment", "embed", "themes", "assign", "report", "result"])
    p.add_argument("--force", action="store_true", help="compute every stage again")
    p.add_argument("--rediscover", action="store_true", help="find the themes again")
    p.add_argument("--n-themes", type=int)
    p.add_argument("--edit", action="append", default=[], help="an edit command, several in order")
    p.add_argument("--suggest", action="store_true", help="try theme counts and say which to ask for")
    p.add_argument("--workbook", help="also write the results as a workbook")
    p.add_argument("--master")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(master=a.master)
    config = Config.load(a.config) if a.config else Config({})
    edits_file = f"{a.run_dir}/edits.json"
    edits = Edits.load(load_json(edits_file))
    if a.n_themes:
        edits = replace(edits, n_themes=a.n_themes)
    table = read_table(spark, a.input)
    if "row_id" not in table.columns:
        table = with_row_ids(table.withColumn("_order", F.monotonically_increasing_id()), ["_order"]).drop("_order")
    if a.edit:
        found = run(spark, table, config.with_overrides(overrides(edits, config.get("themes.curation"))), a.run_dir, a.input, "themes")
        names = [t.name for ts in found.themes.values() for t in ts]
        for line in a.edit:
            try:
                edits = edited(line, edits, names)
            except EditError as e:
                print(e)
                return 2
    if a.suggest:
        rows, best = suggest_count(spark, table, config.with_overrides(overrides(edits, config.get("themes.curation"))), a.run_dir, a.input)
        for r in rows:
            print(" ".join(f"{k}={v:.3g}" if isinstance(v, float) else f"{k}={v}" for k, v in r.items()))
        print(f"ask for {best} themes" if best else "too few clauses")
        return 0
    out = run(spark, table, config.with_overrides(overrides(edits, config.get("themes.curation"))), a.run_dir, a.input, a.until, a.force or a.rediscover)
    save_json(edits_file, edits.record())
    for scope, report in out.report.items():
        print(summary_line(scope, report["summary"]))
    if out.result is not None:
        for name, path in write_tables({"results": out.result, "detail": out.detail, "ratings": out.ratings}, f"{a.run_dir}/tables").items():
            print(f"{name}: {path}")
        if a.workbook:
            write_workbook({"results": out.result, "detail": out.detail}, a.workbook)
            print(f"workbook: {a.workbook}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
