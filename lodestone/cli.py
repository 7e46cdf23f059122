"""Command line: ``python -m lodestone.cli run SOURCE OUT`` and ``python -m lodestone.cli audit FILE...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from .plans import stages
from .session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run stages over a folder of tables")
    run.add_argument("source")
    run.add_argument("out")
    which = run.add_mutually_exclusive_group()
    which.add_argument("--from", dest="start", choices=list(stages.STAGES))
    which.add_argument("--only", choices=list(stages.STAGES))
    which.add_argument("--stages", nargs="+", choices=list(stages.STAGES))
    run.add_argument("--enrich", action="store_true")
    audit = sub.add_parser("audit", help="audit CSV and Parquet files without a schema")
    audit.add_argument("files", nargs="+")
    audit.add_argument("--output")
    audit.add_argument("--format", choices=("text", "markdown", "html"), default="text")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    if a.command == "run":
        for name, seconds in stages.run(spark, a.source, a.out, stages.choose(a.start, a.only, a.stages), a.enrich):
            print(f"{name}: {seconds} s")
        return 0
    r = stages.audit_files(spark, a.files)
    body = {"text": r.text, "markdown": r.markdown, "html": lambda: r.html("Audit")}[a.format]()
    Path(a.output).write_text(body) if a.output else print(body)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
