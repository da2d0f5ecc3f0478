"""python -m inkveil redact|analyze|serve|evaluate"""

from __future__ import annotations

import argparse
import json
import logging
import time

from inkveil.settings import Settings

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkveil", description="Find personal data in documents and replace it.")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("redact", "analyze", "serve", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("--config", help="YAML file; without it, INKVEIL_* variables hold")
        c.add_argument("--seed")
        c.add_argument("--types", help="comma-separated")
        c.add_argument("--no-propagation", action="store_true", help="do not look for further mentions of confirmed names")
        c.add_argument("--redact-public", action="store_true", help="public bodies and domains go too")
        c.add_argument("-v", "--verbose", action="store_true")
        if name == "serve":
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=8000)
        elif name == "evaluate":
            c.add_argument("labels", nargs="+", help="files of labelled records that have their text")
            c.add_argument("-o", "--output", help="file for the results, as JSON")
        else:
            c.add_argument("inputs", nargs="+")
        if name == "redact":
            c.add_argument("-o", "--output", required=True, help="folder for redacted files")
            c.add_argument("--report", help="folder for entities.csv, mapping.json and summary.json")
            c.add_argument("--no-mapping", action="store_true")
        if name == "analyze":
            c.add_argument("--json", action="store_true")
            c.add_argument("--limit", type=int, default=40)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = Settings.from_yaml(args.config) if args.config else Settings.from_env()
    asked = {"seed": args.seed, "types": args.types}
    settings = settings.but(**{k: getattr(Settings.from_mapping(asked), k) for k, v in asked.items() if v})
    settings = settings.but(propagate=settings.propagate and not args.no_propagation, redact_public=settings.redact_public or args.redact_public)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    if args.command == "serve":
        from inkveil.service import serve

        serve(args.host, args.port, settings).serve_forever()
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from inkveil.operators import engine, scoring
    from inkveil.sources import files

    spark, t = SparkSession.builder.getOrCreate(), time.time()
    if args.command == "redact":
        settings = settings.but(emit_mapping=settings.emit_mapping and not args.no_mapping)
        done = files.redact(files.read(spark, args.inputs), settings)
        files.save(done, args.output)
        if args.report:
            print(json.dumps(files.report(done, args.report, settings, round(time.time() - t, 3))))
        return 0
    if args.command == "evaluate":
        suites = {}
        for path in args.labels:
            gold = scoring.locate(scoring.read_labels(spark, path))
            suites[path.rsplit("/", 1)[-1]] = gold, engine.detect(gold.select("id", "text"), settings, redact=False).select("id", "entities")
        done = json.dumps(scoring.results(suites, {"types": settings.types, "propagate": settings.propagate, "min_score": settings.min_score}), ensure_ascii=False)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(done)
        print(done)
        return 0
    text = files.read(spark, args.inputs, tidy=False).select("path", F.array_join("segments", files.GAP, "").alias("text"))
    found = engine.entities(engine.detect(text, settings, redact=False), "path")
    if args.json:
        for row in found.orderBy("path", "start").toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        return 0
    for row in found.groupBy("type").count().orderBy(F.desc("count"), "type").collect():  # a row per type
        print(f"{row['count']:>8}  {row.type}")
    for row in found.orderBy("path", "start").limit(args.limit).collect():
        print(f"{row.type:<14} {row.score:.2f}  {row.text!r}")
    more = found.count() - args.limit
    if more > 0:
        print(f"... {more} more")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
