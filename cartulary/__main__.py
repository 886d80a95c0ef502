"""Command line: python -m cartulary index|brief|eval|capabilities|schema|doctor, or a question."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from dataclasses import asdict

from cartulary.functions import fixed


def hint(token: str) -> str | None:
    """The command that one edit makes of ``token``."""

    def one_edit(a: str, b: str) -> bool:
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    return None if any(map(str.isspace, token)) else next((c for c in fixed.COMMANDS if one_edit(token, c)), None)


def budget(text: str) -> int:
    """8k is 8000."""
    return int(float(text[:-1]) * 1000) if text.lower().endswith("k") else int(text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cartulary")
    out.add_argument("command", help="a command, or a question")
    out.add_argument("root", nargs="?", default=".")
    out.add_argument("--store", help="where generations are kept; in the root by default")
    out.add_argument("--budget", type=budget)
    out.add_argument("--max-dollars", type=float)
    out.add_argument("--markdown-only", action="store_true")
    out.add_argument("--suite")
    out.add_argument("--model", action="store_true", help="let the endpoint of CARTULARY_URL, CARTULARY_MODEL and CARTULARY_KEY write cards and find facts")
    out.add_argument("--router", action="store_true", help="let it name candidates too")
    out.add_argument("--refresh", action="store_true", help="build what is stale before the answer")
    out.add_argument("--yes", action="store_true", help="spend without asking")
    out.add_argument("--ignore", action="append", default=[], help="a rule beside the tree's ignore files; may be repeated")
    out.add_argument("--pretty", action="store_true")
    out.add_argument("--full", action="store_true", help="a query's whole envelope")
    return out


def confirm(cost: dict) -> bool:
    """Asks on a terminal whether to spend; elsewhere nobody can be asked."""
    print(f"{cost['n']} files to card, about ${cost['usd']:.4f}", file=sys.stderr)
    if not sys.stdin.isatty():
        return True
    print("Proceed? [y/N] ", end="", file=sys.stderr, flush=True)
    return sys.stdin.readline().strip().lower() == "y"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    near = hint(args.command)
    if near and args.command not in fixed.COMMANDS:
        print(json.dumps({"state": "usage_error", "hint": f"did you mean {near}?"}))
        return fixed.STATES["usage_error"]
    if args.command in ("capabilities", "schema", "doctor"):
        from cartulary.plans.engine import capabilities, schema

        doctor = lambda: {t: bool(shutil.which(t)) for t in ("git", "pdftotext", "pandoc", "java")}
        data = {"capabilities": capabilities, "schema": schema, "doctor": doctor}[args.command]()
        print(json.dumps(data, indent=2 if args.pretty else None))
        return 0
    if args.command == "help":
        parser().print_help()
        return 0
    if args.command == "eval" and not args.suite:
        print(json.dumps({"state": "usage_error", "hint": "eval needs --suite"}))
        return fixed.STATES["usage_error"]
    from pyspark.sql import SparkSession

    from cartulary.plans.engine import Engine, compact
    from cartulary.plans.provider import HttpProvider
    from cartulary.sources import corpus
    from cartulary.sources.tree import Directory

    spark = SparkSession.builder.appName("cartulary").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files = Directory(spark, args.root, args.ignore, args.markdown_only)
    factory = HttpProvider if args.model else None
    model = os.environ.get("CARTULARY_MODEL", "none") if args.model else "none"
    churn = corpus.version_control_churn(spark, args.root)
    engine = Engine(spark, files, args.store or f"{args.root}/{fixed.INDEX_DIR}", churn, args.markdown_only, model, tuple(args.ignore))
    out = engine.refresh(args.max_dollars, factory) if args.refresh and args.command not in ("index", "eval") else None
    if out is not None and out.state not in ("ok", "partial"):
        pass
    elif args.command == "index":
        out = engine.index(args.max_dollars, factory, None if args.yes or not args.model else confirm)
    elif args.command == "brief":
        out = engine.brief(args.budget)
    elif args.command == "eval":
        out = engine.evaluate(corpus.suite(spark, args.suite), args.max_dollars, factory=factory, routing=args.router)
    else:
        out = engine.query(args.command, factory, routing=args.router, max_usd=args.max_dollars, budget_tokens=args.budget)
    print(json.dumps(asdict(out) if args.full or args.command in fixed.COMMANDS else compact(out), indent=2 if args.pretty else None))
    return out.exit_code


if __name__ == "__main__":
    sys.exit(main())
