"""Database images: the single-file format of the embedded database, read from any file system that Spark reads.

A file of up to WHOLE bytes is one row of Spark's binaryFile source and is walked by one task, so many images are read
in parallel. Of a larger file each page is a row: the driver walks the inner nodes of a tree (by seeking, a page at a
time) and keeps the numbers of its pages in key order, tasks read the cells on them, and what goes on in chains of
overflow pages is grouped by cell, along a list of each page's successor.
A page holds a b-tree node; table leaves hold (rowid, record), index nodes of WITHOUT ROWID tables hold records.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.sources.scratch import written

WHOLE = 16 << 20  # bytes of a file that one task takes at once
SPLIT = 16 << 20  # bytes of a larger file for each task
MAGIC = b"SQLite format 3\0"  # fixed value: the first bytes of a file
_ENCODINGS = {0: "utf-8", 1: "utf-8", 2: "utf-16-le", 3: "utf-16-be"}


class ImageError(ValueError):
    """The file is not an image, or is damaged."""


def varint(b: bytes, at: int) -> tuple[int, int]:
    """A big-endian base-128 number of one to nine bytes, the ninth whole; and where it ends."""
    n = 0
    for i in range(8):
        c = b[at + i]
        n = n << 7 | c & 0x7F
        if c < 0x80:
            return _signed(n), at + i + 1
    return _signed(n << 8 | b[at + 8]), at + 9


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _sums(data: bytes, order: str, sums: tuple[int, int]) -> tuple[int, int]:
    """The running checksum of a write-ahead log over pairs of 32-bit words."""
    a, b = sums
    words = struct.unpack(f"{order}{len(data) // 4}I", data)
    for x, y in zip(words[::2], words[1::2]):
        a = a + x + b & 0xFFFFFFFF
        b = b + y + a & 0xFFFFFFFF
    return a, b


def recovered(data: bytes, log: bytes) -> bytes:
    """An image with the committed frames of its write-ahead log laid over it. Frames count up to the last commit before the
    first one whose salt or checksum is wrong."""
    if len(log) < 32 or log[:4] not in (b"\x37\x7f\x06\x82", b"\x37\x7f\x06\x83"):
        raise ImageError("no write-ahead log")
    order = "<" if log[3] == 0x82 else ">"
    version, size = struct.unpack(">II", log[4:12])
    if version != 3_007_000 or size not in [512 << i for i in range(8)]:
        raise ImageError("unsupported write-ahead log")
    if data and (data[:16] != MAGIC or (struct.unpack(">H", data[16:18])[0] or 65536) not in (size, 1 if size == 65536 else size)) or len(data) % size:
        raise ImageError("the log has another page size")
    sums = _sums(log[:24], order, (0, 0))
    if struct.pack(">II", *sums) != log[24:32]:
        raise ImageError("the log's header has a wrong checksum")
    frames, committed, pages, at = [], 0, len(data) // size, 32
    while at + 24 + size <= len(log):
        number, after = struct.unpack(">II", log[at : at + 8])
        sums = _sums(log[at + 24 : at + 24 + size], order, _sums(log[at : at + 8], order, sums))
        if not number or log[at + 8 : at + 16] != log[16:24] or struct.pack(">II", *sums) != log[at + 16 : at + 24]:
            break
        frames.append((number, at + 24))
        if after:
            committed, pages = len(frames), after
        at += 24 + size
    out = bytearray(data[: pages * size].ljust(pages * size, b"\0"))
    for number, start in frames[:committed]:
        if number <= pages:
            out[(number - 1) * size : number * size] = log[start : start + size]
    return bytes(out)


class Image:
    def __init__(self, data: bytes):
        if data[:16] != MAGIC or len(data) < 512:
            raise ImageError("not a database image")
        size = struct.unpack(">H", data[16:18])[0]
        self.page_size = 65536 if size == 1 else size
        if self.page_size & (self.page_size - 1) or self.page_size < 512:
            raise ImageError("bad page size")
        self.usable = self.page_size - data[20]
        self.encoding = _ENCODINGS.get(struct.unpack(">I", data[56:60])[0], "utf-8")
        self.schema_format = struct.unpack(">I", data[44:48])[0]
        self.user_version, self.application_id = struct.unpack(">i", data[60:64])[0], struct.unpack(">i", data[68:72])[0]
        self.data, self.pages = data, len(data) // self.page_size

    def here(self, size: int, table: bool) -> int:
        """How much of a payload stands on its page."""
        u = self.usable
        most = u - 35 if table else (u - 12) * 64 // 255 - 23
        if size <= most:
            return size
        least = (u - 12) * 32 // 255 - 23
        k = least + (size - least) % (u - 4)
        return k if k <= most else least

    def cells(self, p: bytes, first: bool = False) -> Iterator[tuple[int | None, int, bytes, int]]:
        """Of each cell with a payload on a node's page: rowid, size, what stands on the page, the page where it goes on or 0."""
        h = 100 if first else 0
        kind, cells = p[h], struct.unpack(">H", p[h + 3 : h + 5])[0]
        if kind not in (2, 10, 13):
            raise ImageError("a page is no tree node")
        start = h + (12 if kind == 2 else 8)
        for at in struct.unpack(f">{cells}H", p[start : start + 2 * cells]):
            size, at = varint(p, at + 4 if kind == 2 else at)
            rowid = None
            if kind == 13:
                rowid, at = varint(p, at)
            n = self.here(size, kind == 13)
            yield rowid, size, p[at : at + n], 0 if n == size else struct.unpack(">I", p[at + n : at + n + 4])[0]

    def page(self, n: int) -> bytes:
        if not 1 <= n <= self.pages:
            raise ImageError(f"page {n} is out of range")
        return self.data[(n - 1) * self.page_size : n * self.page_size]

    def payload(self, page: bytes, at: int, size: int, table: bool) -> bytes:
        """A cell's payload: the part on its page and then its chain of overflow pages."""
        u = self.usable
        most = u - 35 if table else (u - 12) * 64 // 255 - 23
        if size <= most:
            return page[at : at + size]
        least = (u - 12) * 32 // 255 - 23
        k = least + (size - least) % (u - 4)
        here = k if k <= most else least
        out, after, seen = [page[at : at + here]], struct.unpack(">I", page[at + here : at + here + 4])[0], 0
        left = size - here
        while left > 0:
            p = self.page(after)
            out.append(p[4 : 4 + min(left, u - 4)])
            left -= u - 4
            after = struct.unpack(">I", p[:4])[0]
            seen += 1
            if seen > self.pages:
                raise ImageError("overflow loop")
        return b"".join(out)

    def rows(self, root: int, depth: int = 0) -> Iterator[tuple[int | None, list]]:
        """(rowid, values) of a table tree, (None, values) of an index tree, in key order."""
        if depth > 40:
            raise ImageError("the tree is too deep")
        p = self.page(root)
        h = 100 if root == 1 else 0
        kind, cells = p[h], struct.unpack(">H", p[h + 3 : h + 5])[0]
        if kind not in (2, 5, 10, 13):
            raise ImageError(f"page {root} is no tree node")
        start = h + (12 if kind in (2, 5) else 8)
        for i in range(cells):
            at = struct.unpack(">H", p[start + 2 * i : start + 2 * i + 2])[0]
            if kind == 5:
                yield from self.rows(struct.unpack(">I", p[at : at + 4])[0], depth + 1)
                continue
            if kind == 2:
                yield from self.rows(struct.unpack(">I", p[at : at + 4])[0], depth + 1)
                at += 4
            size, at = varint(p, at)
            rowid = None
            if kind == 13:
                rowid, at = varint(p, at)
            yield rowid, self.record(self.payload(p, at, size, kind == 13))
        if kind in (2, 5):
            yield from self.rows(struct.unpack(">I", p[h + 8 : h + 12])[0], depth + 1)

    def record(self, b: bytes) -> list:
        """Values by their serial types: NULL, integers of 1 to 8 bytes, a real, 0, 1, blobs and texts."""
        end, at = varint(b, 0)
        body, out = end, []
        while at < end:
            kind, at = varint(b, at)
            if kind == 0:
                out.append(None)
            elif kind in (8, 9):
                out.append(kind - 8)
            elif kind == 7:
                v = struct.unpack(">d", b[body : body + 8])[0]
                out.append(None if v != v else v)
                body += 8
            elif 1 <= kind <= 6:
                n = (1, 2, 3, 4, 6, 8)[kind - 1]
                out.append(int.from_bytes(b[body : body + n], "big", signed=True))
                body += n
            elif kind >= 12:
                n = (kind - 12) // 2
                raw = b[body : body + n]
                if len(raw) != n:
                    raise ImageError("a record is cut short")
                out.append(raw if kind % 2 == 0 else raw.decode(self.encoding, "replace"))
                body += n
            else:
                raise ImageError(f"bad serial type {kind}")
        return out

    def schema(self) -> list[tuple[str, str, str, int, str | None]]:
        """(type, name, table, root page, SQL) of every object."""
        return [tuple(v[:5]) for _, v in self.rows(1)]


class Seeking(Image):
    """An image whose pages the driver reads one at a time."""

    def __init__(self, spark: SparkSession, path: str, length: int):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.file = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
        super().__init__(bytes(self.file.readNBytes(512)))
        self.pages = length // self.page_size

    def page(self, n: int) -> bytes:
        if not 1 <= n <= self.pages:
            raise ImageError(f"page {n} is out of range")
        self.file.seek((n - 1) * self.page_size)
        return bytes(self.file.readNBytes(self.page_size))

    def close(self) -> None:
        self.file.close()

    def tree(self, root: int) -> tuple[np.ndarray, np.ndarray]:
        """Pages with payloads of a tree, in order of their numbers, and the places of each one's first payload: keys of leaves count in
        steps of 65536, and the entry of an inner node lies between two leaves."""
        pages, places, seen = array("q"), array("q"), 0
        depth, n = 0, root
        while (p := self.page(n))[100 if n == 1 else 0] in (2, 5):
            h = 100 if n == 1 else 0
            cells = struct.unpack(">H", p[h + 3 : h + 5])[0]
            at = struct.unpack(">H", p[h + 12 : h + 14])[0] if cells else h + 8
            depth, n = depth + 1, struct.unpack(">I", p[at : at + 4])[0]
            if depth > 40:
                raise ImageError("the tree is too deep")
        place = 0

        def walk(n: int, left: int) -> None:
            nonlocal place, seen
            if not left:
                pages.append(n)
                places.append(place)
                place += 1
                return
            seen += 1
            p = self.page(n)
            h = 100 if n == 1 else 0
            kind, cells = p[h], struct.unpack(">H", p[h + 3 : h + 5])[0]
            if kind not in (2, 5) or seen > self.pages:
                raise ImageError(f"page {n} is no inner node")
            for at in struct.unpack(f">{cells}H", p[h + 12 : h + 12 + 2 * cells]):
                walk(struct.unpack(">I", p[at : at + 4])[0], left - 1)
                if kind == 2:
                    pages.append(n)
                    places.append(place)
                    place += 1
            walk(struct.unpack(">I", p[h + 8 : h + 12])[0], left - 1)

        walk(root, depth)
        pages, places = np.array(pages, np.int64), np.array(places, np.int64)
        order = np.argsort(pages, kind="stable")
        return pages[order], places[order] << 16


#: A frame and what turns its batches into (rowid, values), by number where a tree has no rowids.
Source = tuple[DataFrame, Callable[[Iterator], Iterator[tuple[int, list]]]]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def schema_of(spark: SparkSession, path: str) -> list[tuple]:
    """Objects of the first image at path."""
    first = _files(spark, path).select("path", "length").first()
    if first is None:
        raise ImageError(f"no image at {path}")
    if not first["length"]:
        raise ImageError("not a database image")
    image = Seeking(spark, *first)
    try:
        return image.schema()
    finally:
        image.close()


def _pages(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Number and content of each page of a file, in tasks of SPLIT bytes."""
    conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(max(SPLIT, size)))
    pattern = re.sub(r"([\\{}*?\[\]])", r"\\\1", path).replace(",", "?")  # a comma would part two paths
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if "," in path and len(p.getFileSystem(conf).globStatus(p)) != 1:
        raise ImageError(f"{path} is not the only file of such a name but for its commas")
    rdd = spark._jsc.sc().binaryRecords(pattern, size, conf)
    starts = [p.serializableHadoopSplit().value().getStart() // size for p in rdd.partitions()]
    df = DataFrame(spark._jsparkSession.createDataset(rdd, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).withColumnRenamed("value", "page")
    m = F.col("_m")
    df = df.withColumn("_m", F.monotonically_increasing_id())
    first = F.element_at(F.array(*[F.lit(n).cast("long") for n in starts]), (F.shiftright(m, 33) + 1).cast("int"))
    return df.select((first + m.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n"), "page")


def _placed(tree, batches, image: Image):
    """(place, cell) of the payloads on those pages of the batches that belong to a tree."""
    pages, places = tree.value
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        low, high = np.searchsorted(pages, numbers, "left"), np.searchsorted(pages, numbers, "right")
        for i in np.flatnonzero(low < high):
            p, n = batch.column(1)[int(i)].as_py(), int(numbers[i])
            own = places[low[i] : high[i]].tolist()
            inner = p[100 if n == 1 else 0] == 2
            for j, cell in enumerate(image.cells(p, n == 1)):
                if inner and j >= len(own):
                    raise ImageError("a page is no tree node")
                yield own[j] if inner else own[0] + j, cell


def _paged(spark: SparkSession, path: str, length: int, name: str) -> list[Source]:
    """A table of a large file: payloads that end on their pages, and those that go on in chains."""
    image = Seeking(spark, path, length)
    try:
        if length % image.page_size:
            raise ImageError("the file does not end with a page")
        root = next((r for k, n, _, r, _ in image.schema() if k == "table" and n.lower() == name.lower()), None)
        if root is None:
            raise ImageError(f"no such table: {name}")
        kind, tree = image.page(root)[100 if root == 1 else 0], spark.sparkContext.broadcast(image.tree(root))
    finally:
        image.close()
    bare, every = Image(image.data), _pages(spark, path, image.page_size)
    kinds = [b"\x0d"] if kind in (5, 13) else [b"\x02", b"\x0a"]
    nodes = every.where(F.substring("page", 1, 1).isin(kinds) | (F.col("n") == 1))

    def whole(batches):
        for place, (rowid, size, raw, after) in _placed(tree, batches, bare):
            if not after:
                yield place if rowid is None else rowid, bare.record(raw)

    def far(batches):
        rows = [(place, place if rowid is None else rowid, size, raw, after) for place, (rowid, size, raw, after) in _placed(tree, batches, bare) if after]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["place", "rowid", "size", "raw", "after"])

    heads = written(nodes.mapInArrow(far, "place long, rowid long, size long, raw binary, after long"), "image-heads")
    chains = heads.select("place", "after", (F.col("size") - F.octet_length("raw")).alias("rest")).toArrow()
    if not chains.num_rows:
        return [(nodes, whole)]
    u = bare.usable
    successors = every.select("n", F.conv(F.hex(F.substring("page", 1, 4)), 16, 10).cast("long").alias("next")).toArrow()
    after = np.zeros(image.pages + 1, np.uint32)
    after[successors.column("n").to_numpy()] = successors.column("next").to_numpy().astype(np.uint32)
    place, now, rest = (chains.column(i).to_numpy() for i in range(3))
    links = [np.empty((3, 0), np.int64)]
    step = 0
    while len(now):  # the next page of every chain
        if now.min() < 1 or now.max() > image.pages or step > image.pages:
            raise ImageError("an overflow page is out of range")
        links.append(np.stack([now, place, np.full(len(now), step, np.int64)]))
        on = rest > u - 4
        now, place, rest, step = after[now[on]].astype(np.int64), place[on], rest[on] - (u - 4), step + 1
    links = np.concatenate(links, axis=1)
    links = spark.sparkContext.broadcast(links[:, np.argsort(links[0], kind="stable")])

    def linked(batches):
        pages, places, steps = links.value
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            low, high = np.searchsorted(pages, numbers, "left"), np.searchsorted(pages, numbers, "right")
            out = [(int(places[k]), int(steps[k]), batch.column(1)[int(i)].as_py()[4:u]) for i in np.flatnonzero(low < high) for k in range(low[i], high[i])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["place", "step", "raw"])

    parts = every.mapInArrow(linked, "place long, step long, raw binary")
    parts = parts.unionByName(heads.select("place", F.lit(-1).cast("long").alias("step"), "raw"))
    joined = parts.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("step", "raw"))).alias("parts")).join(heads.select("place", "rowid", "size").hint("merge"), "place")
    joined = joined.select("rowid", "size", F.col("parts.raw").alias("raw"))

    def long(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), bare.record(b"".join(batch.column(2)[i].as_py())[: batch.column(1)[i].as_py()])

    return [(nodes, whole), (written(joined, "image-chains", wide=True), long)]


def _sources(spark: SparkSession, path: str, name: str) -> list[Source]:
    """A table's rows in all images at path."""

    def whole(batches):
        for batch in batches:
            for content in batch.column(0):
                image = Image(content.as_py())
                root = next((r for k, n, _, r, _ in image.schema() if k == "table" and n.lower() == name.lower()), None)
                if root is None:
                    raise ImageError(f"no such table: {name}")
                for number, (rowid, values) in enumerate(image.rows(root), 1):
                    yield rowid if rowid is not None else number, values

    files = _files(spark, path)
    large = files.where(F.col("length") > WHOLE).select("path", "length").collect()  # a row for each large file
    out = [source for f in large for source in _paged(spark, *f, name)]
    small = files.where(F.col("length") <= WHOLE)
    return out if large and small.select("path").first() is None else [(small.select("content"), whole), *out]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def scan_table(spark: SparkSession, path: str, name: str, columns: list[tuple[str, str]], alias: int | None = None, order: list[int] | None = None, sources: list[Source] | None = None) -> DataFrame:
    """Rows of a table in all images at path. columns: names and Spark types; alias: the column that stands for the rowid;
    order: for WITHOUT ROWID tables, the stored place of each column."""
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[t]) for c, t in columns] + [("_rowid_", pa.int64())])
    casts = {"bigint": int, "double": float, "string": lambda v: v if isinstance(v, str) else str(v), "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
    how = [casts[t] for _, t in columns]

    def run(rows):
        def batched(batches):
            cells: list[list] = [[] for _ in schema]
            held = 0
            for rowid, values in rows(batches):
                values += [None] * (len(columns) - len(values))
                for i, f in enumerate(how):
                    v = values[order[i] if order else i]
                    held += len(v) if isinstance(v, (str, bytes)) else 0
                    cells[i].append(rowid if i == alias else None if v is None else f(v))
                cells[-1].append(rowid)
                if len(cells[-1]) >= 10_000 or held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)
                    cells, held = [[] for _ in schema], 0
            if cells[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

        return batched

    ddl = ", ".join(f"`{c}` {t}" for c, t in [*columns, ("_rowid_", "bigint")])
    return _union([df.mapInArrow(run(rows), ddl) for df, rows in sources or _sources(spark, path, name)])


def classes_of(spark: SparkSession, path: str, name: str, sources: list[Source] | None = None) -> dict[int, set[str]]:
    """Storage classes that each stored column of a table holds in the images at path."""
    schema = pa.schema([("at", pa.int32()), ("kind", pa.string())])
    names = {int: "int", float: "real", str: "text", bytes: "blob"}

    def run(rows):
        def found(batches):
            out = set()
            for _, values in rows(batches):
                out.update((i, type(v)) for i, v in enumerate(values) if v is not None)
            yield pa.RecordBatch.from_pydict({"at": pa.array([i for i, _ in out], pa.int32()), "kind": pa.array([names[t] for _, t in out], pa.string())}, schema=schema)

        return found

    out: dict[int, set[str]] = {}
    for r in _union([df.mapInArrow(run(rows), "at int, kind string") for df, rows in sources or _sources(spark, path, name)]).distinct().collect():  # four kinds for a column at most
        out.setdefault(r["at"], set()).add(r["kind"])
    return out


def attach(connection, path: str) -> list[str]:
    """Loads every table and view of an image into a connection by replaying its CREATE statements; gives their names."""
    from sedge.sql.connection import _SPARK, ROWID

    made = []
    for kind, name, _, _, sql in schema_of(connection.spark, path):
        if name.startswith("sqlite_") or not sql or kind not in ("table", "view", "index"):
            continue
        connection.execute(sql)
        made.append(name)
        if kind != "table":
            continue
        t = connection.catalog.table(name)
        order = None
        if t.without_rowid:
            key = [c for c in sorted(t.columns, key=lambda c: c.pk) if c.pk]
            stored = [*key, *[c for c in t.columns if not c.pk]]
            order = [stored.index(c) for c in t.columns]
        stored_columns = [c for c in t.columns if c.generated is None or c.stored]
        sources = _sources(connection.spark, path, name)
        kinds = classes_of(connection.spark, path, name, sources)
        for i, c in enumerate(stored_columns):
            held = kinds.get(order[i] if order else i, set())
            if held and c.label != t.rowid_alias:
                c.ty = held.pop() if len(held) == 1 else "real" if held <= {"int", "real"} else "text"
                c.ty = "real" if c.ty == "int" and c.aff == "real" else c.ty  # whole reals are stored as integers
        columns = [(c.label, _SPARK[c.ty]) for c in stored_columns]
        alias = next((i for i, c in enumerate(stored_columns) if c.label == t.rowid_alias), None)
        df = scan_table(connection.spark, path, name, columns, alias, order, sources)
        connection._store(t, connection._generate(t, df.select(*[F.col(f"`{c}`") for c, _ in columns], ROWID)))
    return made
