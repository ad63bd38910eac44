"""SQL from standard input, one JSON object for each statement:

python -m sedge [--tables FOLDER] [--load IMAGE] [--save IMAGE] [--store FOLDER] < script.sql
"""

from __future__ import annotations

import argparse
import json
import sys


def tagged(v):
    if v is None:
        return {"null": None}
    if isinstance(v, (bytes, bytearray)):
        return {"blob": bytes(v).hex()}
    return {{bool: "integer", int: "integer", float: "real"}.get(type(v), "text"): v if isinstance(v, (int, float, str)) else str(v)}


def main() -> int:
    args = argparse.ArgumentParser(prog="sedge")
    args.add_argument("--tables", help="folder of Parquet tables to register")
    args.add_argument("--load", "--image", dest="load", help="database image to load")
    args.add_argument("--save", help="database image to write at the end; must not be there yet")
    args.add_argument("--store", help="folder that the connection is kept in: each commit is written there")
    given = args.parse_args()
    from pyspark.sql import SparkSession

    from sedge.sql.connection import Connection
    from sedge.sql.lexer import SqlError
    from sedge.sql.parser import parse

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.store:
        from sedge.sources.store import opened

        con = opened(spark, given.store)
    else:
        con = Connection(spark)
    if given.tables:
        from sedge.plans.catalogue import ORDER, TABLES

        for name in TABLES:
            con.offer(name, lambda path=f"{given.tables}/{name}.parquet": spark.read.parquet(path), ORDER.get(name))
    if given.load:
        from sedge.sources.image import attach

        attach(con, given.load)
    try:
        for statement in parse(sys.stdin.read()):
            r = con.execute_prepared(statement)
            print(json.dumps({"columns": r.columns, "rows": [[tagged(v) for v in row] for row in r.rows()], "changes": r.changes}, ensure_ascii=False))
        if given.save:
            from sedge.sources.image_writer import export

            export(con, given.save)
    except SqlError as e:
        print(json.dumps({"error": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
