"""Command line: ``python -m siftwell.plans.cli STAGE --root DIR --articles P --labelled P --queries P``."""

from __future__ import annotations

import argparse
import logging

from siftwell.plans import config as C
from siftwell.plans.stages import Run
from siftwell.session import session

STAGES = ("preprocess", "make-folds", "retrieve", "evaluate", "fuse", "rerank", "blend", "make-answer", "validate-answer", "all")
log = logging.getLogger("siftwell")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell")
    p.add_argument("stage", choices=STAGES)
    for name in ("root", "articles", "labelled", "queries"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", action="append", default=[], help="YAML files, later ones win")
    p.add_argument("--set", action="append", default=[], metavar="A.B=V")
    p.add_argument("--force", action="store_true")
    p.add_argument("--master")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = session(args.master)
    read = spark.read.parquet
    run = Run(spark, args.root, read(args.articles), read(args.labelled), read(args.queries), C.load(args.config, args.set), args.force)
    out = getattr(run, args.stage.replace("-", "_"))()
    if hasattr(out, "show"):
        out.show(truncate=False)
    else:
        log.info("%s: %s", args.stage, "done" if out else "fresh, skipped")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
