"""Command line: scan a folder or repository into a wiki, ask about it, and keep settings."""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import sys
from dataclasses import fields, replace
from pathlib import Path

from codequarry.config import Config


def set_up_logging(folder: str) -> None:
    """Log to a file in folder that is rotated, warnings to the console as well."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    handler = logging.handlers.RotatingFileHandler(Path(folder) / "codequarry.log", maxBytes=5 << 20, backupCount=3, encoding="utf-8")
    console = logging.StreamHandler()
    console.setLevel(logging.WARNING)
    logging.basicConfig(level=logging.INFO, handlers=[handler, console], format="%(asctime)s %(levelname)s %(message)s", force=True)


def shown(config: Config) -> list[str]:
    """A line a setting; of a key only its ends."""
    mask = lambda v: v[:4] + "..." + v[-4:] if len(v) > 8 else "***"
    return [f"{f.name} = {mask(v) if f.name == 'api_key' and v else v}" for f in fields(config) for v in [getattr(config, f.name)]]


def configure(action: str, key: str | None, value: str | None, folder: str = ".") -> list[str]:
    """What `config list`, `config get KEY` and `config set KEY VALUE` print."""
    config = Config.load(folder)
    names = {f.name: f.type for f in fields(Config)}
    if action == "list":
        return shown(config)
    if key not in names:
        return [f"unknown setting: {key}"]
    if action == "get":
        return [x for x in shown(config) if x.startswith(f"{key} = ")]
    replace(config, **{key: int(value) if names[key] == "int" else value}).save(folder)
    return [f"{key} is set"]


def scan(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from codequarry.operators.index import language_breakdown
    from codequarry.plans import wiki
    from codequarry.sources import repositories, sinks
    from codequarry.sources.files import scan_directory

    spark = SparkSession.builder.appName("codequarry").getOrCreate()
    config = Config.load()
    config = replace(config, **{k: v for k, v in (("output_dir", args.out), ("language", args.language), ("generation_mode", args.mode)) if v})
    set_up_logging(config.output_dir)
    root = args.source
    if repositories.is_url(spark, root):
        parts = repositories.url_parts(spark, root)
        root = str(repositories.fetch(repositories.clone_url(*parts) if parts else root, Path(config.output_dir) / ".clones" / root.rstrip("/").rsplit("/", 1)[-1], args.force))
    if not Path(root).is_dir():
        print(f"no folder: {root}", file=sys.stderr)
        return 1
    for r in language_breakdown(scan_directory(spark, root, config.max_file_size, config.max_files)).collect():
        print(f"{r.language:<12} {r.n_files}")
    if args.list_only:
        return 0
    record = wiki.build(spark, root, config.output_dir, config=config, on_progress=print)
    if args.format == "json":
        tables = wiki.ingest(spark, root, config)
        sinks.write_json(tables["files"].drop("content"), f"{config.output_dir}/files")
    print(f"{record.count()} pages in {config.output_dir}")
    return 0


def ask(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from codequarry.plans.project import Project

    project = Project(SparkSession.builder.appName("codequarry").getOrCreate(), args.source, Config.load()).scan()
    print(project.ask(args.question).first().answer if project.status == "done" else project.message)
    return 0 if project.status == "done" else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("codequarry")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="write the wiki of a folder or repository")
    one.add_argument("source")
    one.add_argument("-o", "--out")
    one.add_argument("-f", "--format", choices=("markdown", "json"), default="markdown")
    one.add_argument("-l", "--language")
    one.add_argument("-m", "--mode", choices=("full", "incremental", "resume"))
    one.add_argument("--force", action="store_true", help="clone again")
    one.add_argument("--list-only", action="store_true", help="count files by language and stop")
    two = commands.add_parser("chat", help="ask about a folder or repository")
    two.add_argument("source")
    two.add_argument("question")
    three = commands.add_parser("config", help="settings")
    three.add_argument("action", choices=("list", "get", "set"))
    three.add_argument("key", nargs="?")
    three.add_argument("value", nargs="?")
    args = parser.parse_args(argv)
    if args.command == "config":
        print("\n".join(configure(args.action, args.key, args.value)))
        return 0
    return scan(args) if args.command == "scan" else ask(args)


if __name__ == "__main__":
    sys.exit(main())
