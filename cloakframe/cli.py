"""Command line: python -m cloakframe.cli analyze|anonymize|process-files|reverse|rotate ..."""

from __future__ import annotations

import argparse
import getpass
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import anonymize as A
from cloakframe.operators import engine, mapping
from cloakframe.operators.documents import process_documents
from cloakframe.sources import office, tables


def _policies(path: str | None) -> dict[str, A.Policy] | None:
    """{"PERSON": {"operator": "mask", "params": {...}}, "DEFAULT": ...} from a JSON file."""
    if not path:
        return None
    with open(path) as f:
        return {k: A.Policy(v["operator"], v.get("params", {})) for k, v in json.load(f).items()}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="cloakframe")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("analyze", "anonymize", "process-files"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--entities", nargs="*")
        p.add_argument("--threshold", type=float)
        p.add_argument("--policies")
        p.add_argument("--salt", default="")
    for name in ("reverse", "rotate"):
        p = sub.add_parser(name)
        p.add_argument("store")
        p.add_argument("pseudonym", nargs="?")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("cloakframe").getOrCreate()
    if args.command in ("reverse", "rotate"):
        store = mapping.EncryptedStore(spark, args.store)
        if args.command == "rotate":
            store.rotate(getpass.getpass("Old passphrase: "), getpass.getpass("New passphrase: "))
        else:
            store.unlock(getpass.getpass("Passphrase: "))
            store.load().where(F.col("pseudonym") == args.pseudonym).show(truncate=False)
        return 0
    if args.command == "process-files":
        clean, quarantine = process_documents(office.read_files(spark, args.input), _policies(args.policies), threshold=args.threshold, entities=args.entities, salt=args.salt)
        print(f"{office.save_files(clean, args.output).count()} files written")
        leaked = quarantine.count()
        print(f"{leaked} files kept back by the leak check")
        return int(leaked > 0)
    docs = tables.read_texts(spark, args.input)
    if args.command == "analyze":
        found = engine.analyze_rows(docs, threshold=args.threshold, entities=args.entities).select("doc_id", "spans")
    else:
        found = engine.process_text(docs, _policies(args.policies), threshold=args.threshold, entities=args.entities, salt=args.salt).select("doc_id", "anonymized", F.size("leaks").alias("leaks"))
    found.write.json(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
