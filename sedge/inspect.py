"""Looks into a database image: python -m sedge.inspect IMAGE info|schema|rows [ROOT_PAGE] [--wal LOG]

One JSON object for each line: the header, the objects, or the rows of the tree at a root page, with tagged values.
A file that lies beside a journal or log with content is refused, but for a log that is named.
"""

from __future__ import annotations

import json
import os
import sys

from sedge.__main__ import tagged
from sedge.sources.image import Image, ImageError, recovered


def opened(path: str, log: str | None = None) -> Image:
    for suffix in ("-wal", "-journal"):
        beside = path + suffix
        if os.path.exists(beside) and os.path.getsize(beside) and not (suffix == "-wal" and log):
            raise ImageError(f"{beside} has content: use a checkpointed copy or name the log")
    with open(path, "rb") as f:
        data = f.read()
    if log:
        with open(log, "rb") as f:
            data = recovered(data, f.read())
    return Image(data)


def lines(args: list[str]):
    """What a command line asks for, a JSON object at a time."""
    args = list(args)
    log = None
    if "--wal" in args:
        at = args.index("--wal")
        if at + 1 == len(args):
            raise ImageError("--wal needs a path")
        log = args[at + 1]
        del args[at : at + 2]
    if len(args) < 2 or args[1] not in ("info", "schema", "rows") or len(args) != (3 if args[1] == "rows" else 2):
        raise ImageError("expected IMAGE info|schema|rows [ROOT_PAGE] [--wal LOG]")
    image = opened(args[0], log)
    if args[1] == "info":
        yield {"page_size": image.page_size, "pages": image.pages, "encoding": image.encoding, "schema_format": image.schema_format}
    elif args[1] == "schema":
        for kind, name, table, root, sql in image.schema():
            yield {"kind": kind, "name": name, "table": table, "root_page": root, "sql": sql}
    else:
        for rowid, values in image.rows(int(args[2])):
            yield {"rowid": rowid, "values": [tagged(v) for v in values]}


def main() -> int:
    try:
        for line in lines(sys.argv[1:]):
            print(json.dumps(line, ensure_ascii=False))
    except (ImageError, OSError, ValueError) as e:
        print(json.dumps({"error": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
