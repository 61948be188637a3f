"""``python -m presetlake.importers``: write model files from Parquet tables, a database or a Prisma schema, with presets for selections."""

from __future__ import annotations

import argparse
from pathlib import Path

import yaml

from presetlake.importers import prisma, selection
from presetlake.importers.catalog import from_tables


def write(models: dict[str, dict], folder: str | Path) -> list[Path]:
    """One file for each model; existing files of the same names are replaced."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for name, model in models.items():
        out.append(folder / f"{name}.yml")
        out[-1].write_text(yaml.safe_dump(model, allow_unicode=True, sort_keys=False), encoding="utf-8")
    return out


def main(args: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="python -m presetlake.importers", description=__doc__)
    ask.add_argument("--tables", help="folder of <name>.parquet")
    ask.add_argument("--jdbc-url", help="database whose --jdbc-tables are read")
    ask.add_argument("--jdbc-tables", default="", help="their names, with commas between them")
    ask.add_argument("--jdbc-driver", help="class of the driver, where the URL doesn't find it")
    ask.add_argument("--keys", help="YAML file: primary (table: [columns]) and foreign (table.column: table.column)")
    ask.add_argument("--prisma-schema", help="Prisma schema file")
    ask.add_argument("--locale", help="locale file that gets the texts of enums")
    ask.add_argument("--selections", help="YAML file: a list of root, operation and fields (nested lists), which get presets")
    ask.add_argument("--replace-presets", action="store_true", help="presets of selections replace those of the same name")
    ask.add_argument("--only-simple", action="store_true", help="only tables without foreign keys")
    ask.add_argument("--out", default="./models")
    ask.add_argument("--dry-run", action="store_true", help="print instead of writing")
    given = ask.parse_args(args)
    words: dict = {}
    if given.prisma_schema:
        models, words = prisma.read(Path(given.prisma_schema).read_text(encoding="utf-8"))
    elif given.tables or given.jdbc_url:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        keys = yaml.safe_load(Path(given.keys).read_text(encoding="utf-8")) if given.keys else {}
        foreign = {tuple(a.split(".")): tuple(b.split(".")) for a, b in (keys.get("foreign") or {}).items()}
        if given.jdbc_url:
            reader = spark.read.format("jdbc").option("url", given.jdbc_url)
            reader = reader.option("driver", given.jdbc_driver) if given.jdbc_driver else reader
            tables = {n.lower(): reader.option("dbtable", n).load() for n in map(str.strip, given.jdbc_tables.split(",")) if n}
            tables = {n: df.toDF(*map(str.lower, df.columns)) for n, df in tables.items()}
        else:
            tables = {p.stem: spark.read.parquet(str(p)) for p in sorted(Path(given.tables).glob("*.parquet"))}
        models = from_tables(tables, foreign, keys.get("primary"), given.only_simple)
    else:
        ask.error("give --tables, --jdbc-url or --prisma-schema")
    for one in yaml.safe_load(Path(given.selections).read_text(encoding="utf-8")) if given.selections else []:
        models, warnings = selection.add_presets(models, one["root"], one["fields"], one.get("operation") or "", given.replace_presets)
        for text in warnings:
            print(f"warning: {text}")
    if given.dry_run:
        print(yaml.safe_dump({"models": models, "locale": words}, allow_unicode=True, sort_keys=False))
        return
    for path in write(models, given.out):
        print(path)
    if words and given.locale:
        prisma.merge_words(given.locale, words)


if __name__ == "__main__":
    main()
