"""python -m memloom [--maildir DIR | --threads FILE] --out DIR [--skip-extract] [--model MODULE:FUNCTION | --no-llm] [--question TEXT ...]

Without a source the sample threads are used.
"""

from __future__ import annotations

import argparse
import importlib
import json

from memloom import schemas
from memloom.pipeline import run
from memloom.session import local_session
from memloom.sources.mail import read_source


def main() -> None:
    p = argparse.ArgumentParser(prog="memloom", description="Build the memory graph of a message collection and answer questions.")
    source = p.add_mutually_exclusive_group()
    source.add_argument("--maildir")
    source.add_argument("--threads")
    p.add_argument("--out", required=True)
    p.add_argument("--skip-extract", action="store_true", help="use the extraction that --out already has")
    llm = p.add_mutually_exclusive_group()
    llm.add_argument("--model", help="MODULE:FUNCTION, a function from prompt to text; extraction and answers use it besides the rules")
    llm.add_argument("--no-llm", action="store_true", help="rules only (the default)")
    p.add_argument("--question", action="append", default=[])
    p.add_argument("--least", type=int, default=schemas.THREAD_MIN)
    p.add_argument("--target", type=int, default=schemas.THREAD_TARGET)
    a = p.parse_args()
    spark = local_session()
    messages = read_source(spark, a.maildir, a.threads)
    model = None
    if a.model:
        module, _, name = a.model.partition(":")
        model = getattr(importlib.import_module(module), name)
    print(json.dumps(run(spark, messages, a.out, questions=a.question, least=a.least, target=a.target, skip_extract=a.skip_extract, model=model, answers=model), indent=1))


if __name__ == "__main__":
    main()
