"""Command line: tallyward <dataset> [--schema ...] [--rules ...]."""

from __future__ import annotations

import argparse
import json
import signal
import sys
import threading

from tallyward.plans.pipeline import NO_CHECKS, VERSION, Result, RunError, build_summary, run_qc
from tallyward.session import local_session

EXIT = {"usage": 1, "input": 2, "schema": 3, "run": 4, "report": 5}
FAIL_ON, INTERRUPTED = 6, 130


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise RunError("usage", message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tallyward", description="Check a table against JSON Schemas, quality rules, or both.")
    p.add_argument("dataset", nargs="*")
    p.add_argument("--schema", action="append", default=[], help="schema file, folder or web address; repeatable, never a mix of paths and addresses")
    p.add_argument("--rules", action="append", default=[], help="rules file; repeatable, in the order of corrections")
    p.add_argument("--index", help="which schema file is the root")
    p.add_argument("--sheet", help="sheet of a workbook")
    p.add_argument("--out", help="report file, or a folder for it")
    p.add_argument("--no-corrections", action="store_true")
    p.add_argument("--summary", help="write the summary as JSON; - for standard output")
    p.add_argument("--fail-on", choices=("error", "warning", "none"), default="none")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--version", action="store_true")
    return p


def reached(result: Result, level: str) -> bool:
    totals = result.store.summary().severity_totals
    return level != "none" and (totals["error"] > 0 or level == "warning" and totals["warning"] > 0)


def main(argv: list[str] | None = None, spark=None) -> int:
    say = lambda text: print(text, file=sys.stderr)
    cancel = threading.Event()
    try:
        args = parser().parse_args(argv)
        if args.version:
            print(VERSION)
            return 0
        if not args.dataset:
            raise RunError("usage", "Name the dataset to check: tallyward <dataset> [options].")
        if len(args.dataset) > 1:
            raise RunError("usage", "Only one dataset can be checked per run — the extra arguments below look misplaced.", args.dataset[1:])
        if not args.schema and not args.rules:
            raise RunError("usage", NO_CHECKS)
        if threading.current_thread() is threading.main_thread():
            signal.signal(signal.SIGINT, lambda *_: cancel.set())
        progress = None if args.quiet else lambda stage, text: say(f"{stage}: {text}")
        result = run_qc(spark or local_session(), args.dataset[0], args.schema, args.rules, args.index, args.sheet, args.out, not args.no_corrections, progress, cancel)
        for warning in result.dataset.warnings:
            say(f"warning: {warning}")
        code = FAIL_ON if reached(result, args.fail_on) else 0
        if args.summary:
            text = json.dumps(build_summary(result, code), indent=2, ensure_ascii=False)
            try:
                if args.summary == "-":
                    print(text)
                else:
                    with open(args.summary, "w", encoding="utf-8") as f:
                        f.write(text + "\n")
            except OSError as e:
                raise RunError("report", f"Could not write the summary to '{args.summary}'.") from e
        if not args.quiet:
            say(f"report: {result.out_path}")
        return code
    except RunError as e:
        say(f"error: {e}")
        for line in e.detail:
            say(f"  {line}")
        return INTERRUPTED if cancel.is_set() else EXIT[e.kind]
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:
        say(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        return EXIT["run"]


if __name__ == "__main__":
    sys.exit(main())
