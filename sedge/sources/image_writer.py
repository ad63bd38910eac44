"""Database images written: a connection's tables, views and indexes in the single-file format of the embedded database.

A page holds a b-tree node. Rows fill leaves from left to right; a level of inner nodes is laid over the one below
until one node is left. In index trees the entry between two nodes stands in the node above them.

Spark sorts the rows of a tree and tasks pack them into leaves, with page numbers counted from the first page of the
task; these become places in the file once the pages of all tasks are counted. The driver holds the page and last rowid
of each leaf of a table, the entries between the leaves of an index, and lays the inner nodes. One file has one writer:
the driver's JVM copies the tasks' pages into it as a stream.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions import scalar as S
from sedge.functions.scalar import E
from sedge.sources.image import MAGIC
from sedge.sources.scratch import fresh_path, written
from sedge.sql import text
from sedge.sql.connection import ROWID, Connection, Key, Table
from sedge.sql.lexer import SqlError

MOST_PAGES = (1 << 32) - 2  # fixed value: page numbers of the format
PAGE_SIZES = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)
BLOCK = 128 << 10  # bytes of pages in a row that a task hands on


class Text(bytes):
    """A text as its UTF-8 bytes."""


def varint(n: int) -> bytes:
    """A big-endian base-128 number of one to nine bytes, the ninth whole."""
    if 0 <= n < 128:
        return bytes((n,))
    n &= (1 << 64) - 1
    if n >= 1 << 56:
        out, n = [n & 0xFF], n >> 8
        for _ in range(8):
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes(reversed(out))
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def record(values: Iterable) -> bytes:
    """Serial types and bodies of the values."""
    kinds, bodies = b"", []
    for v in values:
        if v is None:
            kind, body = 0, b""
        elif isinstance(v, float):
            kind, body = 7, struct.pack(">d", v)
        elif isinstance(v, int):
            if v in (0, 1):
                kind, body = 8 + v, b""
            else:
                size = next(n for n in (1, 2, 3, 4, 6, 8) if -(1 << 8 * n - 1) <= v < 1 << 8 * n - 1)
                kind, body = (1, 2, 3, 4, 6, 8).index(size) + 1, v.to_bytes(size, "big", signed=True)
        elif isinstance(v, Text):
            kind, body = 13 + 2 * len(v), v
        elif isinstance(v, (bytes, bytearray)):
            kind, body = 12 + 2 * len(v), bytes(v)
        else:
            body = str(v).encode("utf-8", "surrogatepass")
            kind = 13 + 2 * len(body)
        kinds += varint(kind)
        bodies.append(body)
    n = len(kinds) + 1
    while len(varint(n)) + len(kinds) != n:
        n = len(varint(n)) + len(kinds)
    return varint(n) + kinds + b"".join(bodies)


class Nodes:
    """Nodes of trees in pages of one size."""

    def __init__(self, size: int):
        if size not in PAGE_SIZES:
            raise SqlError("bad page size")
        self.size = size

    def add(self, content: bytes, fixes: Iterable[int] = ()) -> int:
        """Takes a page and gives its number. fixes: where page numbers stand in it."""
        raise NotImplementedError

    def payload(self, raw: bytes, table: bool) -> tuple[bytes, bool]:
        """What of a payload stands in its cell, and whether the rest went to a chain of pages, whose number ends it."""
        u = self.size
        most = u - 35 if table else (u - 12) * 64 // 255 - 23
        if len(raw) <= most:
            return raw, False
        least = (u - 12) * 32 // 255 - 23
        k = least + (len(raw) - least) % (u - 4)
        here = k if k <= most else least
        after, fixes = 0, ()
        for i in reversed(range(here, len(raw), u - 4)):
            after, fixes = self.add(struct.pack(">I", after) + raw[i : i + u - 4].ljust(u - 4, b"\0"), fixes), (0,)
        return raw[:here] + struct.pack(">I", after), True

    def node(self, kind: int, cells: list[bytes], right: int = 0, head: int = 0) -> bytes:
        """A node of a tree: header, places of the cells, and the cells from the end."""
        top = head + (12 if right else 8)
        body, places, at = [], [], self.size
        for c in cells:
            at -= len(c)
            places.append(at)
            body.append(c)
        header = struct.pack(">BHHHB", kind, 0, len(cells), at & 0xFFFF, 0) + (struct.pack(">I", right) if right else b"")
        pointers = struct.pack(f">{len(places)}H", *places)
        gap = at - top - len(pointers)
        assert gap >= 0
        return header + pointers + bytes(gap) + b"".join(reversed(body))

    def room(self, leaf: bool, head: int = 0) -> int:
        return self.size - head - (8 if leaf else 12)

    def leaf(self, kind: int, cells: list[tuple[bytes, bool]]) -> int:
        """A leaf of (cell, whether it goes on in a chain)."""
        at, fixes = self.size, []
        for c, far in cells:
            if far:
                fixes.append(at - 4)
            at -= len(c)
        return self.add(self.node(kind, [c for c, _ in cells]), fixes)


class Part(Nodes):
    """The pages of one task, numbered from 0, handed on in blocks."""

    SCHEMA = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("kind", pa.int8()), ("n", pa.int32()), ("body", pa.binary()), ("fixes", pa.binary()),
        ("leaves", pa.binary()), ("last", pa.binary()), ("cells", pa.list_(pa.binary())), ("far", pa.binary()),
    ])
    DDL = "part int, seq int, kind tinyint, n int, body binary, fixes binary, leaves binary, last binary, cells array<binary>, far binary"
    HEAD, BLOCK, TAIL = 0, 1, 2

    def __init__(self, size: int):
        super().__init__(size)
        self.part, self.seq, self.count = TaskContext.get().partitionId(), 0, 0
        self.fresh()

    def fresh(self) -> None:
        self.pages, self.fixes = [], array("I")
        self.leaves, self.last, self.between = array("q"), array("q"), []

    def add(self, content: bytes, fixes: Iterable[int] = ()) -> int:
        for f in fixes:
            self.fixes.append(len(self.pages) * self.size + f)
        self.pages.append(content)
        self.count += 1
        return self.count - 1

    def row(self, kind: int, cells: list[tuple[bytes, bool]]) -> pa.RecordBatch:
        """A row of what came since the last one; cells: those at the ends of an index's part, or those behind its leaves."""
        values = [self.part, self.seq, kind, len(self.pages), b"".join(self.pages), self.fixes.tobytes(), self.leaves.tobytes(), self.last.tobytes(), [c for c, _ in cells], bytes(f for _, f in cells)]
        out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, self.SCHEMA)], schema=self.SCHEMA)
        self.seq += 1
        self.fresh()
        return out

    def blocks(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        if len(self.pages) * self.size >= BLOCK or end and self.pages:
            yield self.row(self.BLOCK, self.between)

    def table(self, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        """(rowid, values) in order."""
        leaf, used, room, before = [], 0, self.room(True), 0
        for rowid, values in rows:
            raw = record(values)
            body, far = self.payload(raw, True)
            cell = varint(len(raw)) + varint(rowid) + body
            if leaf and used + len(cell) + 2 > room:
                self.leaves.append(self.leaf(13, leaf))
                self.last.append(before)
                leaf, used = [], 0
                yield from self.blocks()
            leaf.append((cell, far))
            used, before = used + len(cell) + 2, rowid
        if leaf:
            self.leaves.append(self.leaf(13, leaf))
            self.last.append(before)
        yield from self.blocks(True)

    def index(self, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        """Entries in order. The first two nodes and the last go on as cells, for the driver to join with those of the next parts."""
        leaf, used, room = [], 0, self.room(True)
        closed, held = 0, None
        for values in rows:
            raw = record(values)
            body, far = self.payload(raw, False)
            cell = (varint(len(raw)) + body, far)
            if used + len(cell[0]) + 2 <= room:
                leaf.append(cell)
                used += len(cell[0]) + 2
                yield from self.blocks()
                continue
            closed += 1
            if closed == 1:
                yield self.row(self.HEAD, [*leaf, cell])
            else:
                if held is not None:
                    self.leaves.append(self.leaf(10, held[0]))
                    self.between.append(held[1])
                held = leaf, cell
            leaf, used = [], 0
            yield from self.blocks()
        tail = [*held[0], held[1], *leaf] if held is not None else leaf
        yield from self.blocks(True)
        if tail:
            yield self.row(self.TAIL, tail)


class Blocks:
    """The pages that tasks made of a tree, and where each task's begin in the file."""

    def __init__(self, df: DataFrame, first: int):
        self.df, self.rows = df, df.withColumn("fixed", F.octet_length("fixes") > 0).drop("body", "fixes").orderBy("part", "seq").collect()  # a row for each block
        self.at, self.count, self.fixed = {}, 0, False
        for r in self.rows:
            self.at.setdefault(r["part"], first + self.count)
            self.count += r["n"]
            self.fixed = self.fixed or r["fixed"]

    def streamed(self, size: int) -> tuple[str, list[int]]:
        """A folder of text files whose lines are the blocks in order, and the bytes of each."""
        spark, at = self.df.sparkSession, self.at

        def placed(batches):
            for batch in batches:
                bodies = []
                for part, body, fixes in zip(*(c.to_pylist() for c in batch.columns[2:5])):
                    body = bytearray(body)
                    for f in array("I", fixes):
                        struct.pack_into(">I", body, f, struct.unpack_from(">I", body, f)[0] + at[part])
                    bodies.append(bytes(body))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], names=["p", "s", "body"])

        df = self.df.where("n > 0").select(F.col("part").alias("p"), F.col("seq").alias("s"), "part", "body", "fixes")
        df = df.mapInArrow(placed, "p int, s int, body binary") if self.fixed else df
        folder = fresh_path(spark, "image-pages")
        df.orderBy("p", "s").select(F.col("body").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(folder)
        return folder, [r["n"] * size for r in self.rows if r["n"]]


class Pages(Nodes):
    """The pages of a file under construction: the driver's own, and those of tasks. Page 1 holds the header and the root of the schema."""

    def __init__(self, size: int):
        super().__init__(size)
        self.pieces: list[list[bytes] | Blocks] = [[b""]]
        self.count = 1

    def add(self, content: bytes, fixes: Iterable[int] = ()) -> int:
        self.grow(1)
        if isinstance(self.pieces[-1], Blocks):
            self.pieces.append([])
        self.pieces[-1].append(content)
        return self.count

    def grow(self, n: int) -> None:
        if self.count + n > MOST_PAGES:
            raise SqlError(f"the image would have more than {MOST_PAGES} pages")
        self.count += n

    def blocks(self, df: DataFrame) -> Blocks:
        out = Blocks(written(df, "image-blocks", wide=True), self.count + 1)
        self.grow(out.count)
        self.pieces.append(out)
        return out

    def table(self, df: DataFrame, rows) -> int:
        """The tree of a sorted frame whose batches rows turns into (rowid, values); gives the root."""
        size = self.size
        blocks = self.blocks(df.mapInArrow(lambda batches: Part(size).table(rows(batches)), Part.DDL))
        pages, last = array("q"), array("q")
        for r in blocks.rows:
            pages.extend(blocks.at[r["part"]] + n for n in array("q", r["leaves"]))
            last.frombytes(r["last"])
        return self.over_table(pages, last) if pages else self.root(13, [], 0, False)

    def over_table(self, pages: array, last: array, root: bool = False) -> int:
        """Inner nodes over the leaves of a table, given their last rowids."""
        head = 100 if root else 0
        while len(pages) > 1 or root:
            up, up_last, group, used, held = array("q"), array("q"), [], 0, None

            def closed(group: list[int]) -> None:
                cells = [struct.pack(">I", pages[i]) + varint(last[i]) for i in group[:-1]]
                up.append(self.add(self.node(5, cells, pages[group[-1]])))
                up_last.append(last[group[-1]])

            sizes = (6 + len(varint(k)) for k in last)
            if len(pages) <= self.size // 7 + 1 and sum(sizes) - 6 - len(varint(last[-1])) <= self.room(False, head):
                return self.root(5, [struct.pack(">I", p) + varint(k) for p, k in zip(pages[:-1], last)], pages[-1], root)
            for i, k in enumerate(last):
                n = 6 + len(varint(k))
                if group and used + n > self.room(False):
                    if held:
                        closed(held)
                    held, group, used = group, [], 0
                group.append(i)
                used += n
            if len(group) == 1 and held:  # a node has two children at least
                group.insert(0, held.pop())
            if held:
                closed(held)
            closed(group)
            pages, last = up, up_last
        return pages[0]

    def table_tree(self, rows: Iterable[tuple[int, bytes]], root: bool = False) -> int:
        """(rowid, record) in order, of a small table; gives the root. root: the tree's root is page 1."""
        leaf, used, before = [], 0, 0
        pages, last = array("q"), array("q")
        room = self.room(True, 100 if root else 0)
        for rowid, raw in rows:
            cell = varint(len(raw)) + varint(rowid) + self.payload(raw, True)[0]
            if leaf and used + len(cell) + 2 > room:
                pages.append(self.add(self.node(13, leaf)))
                last.append(before)
                leaf, used = [], 0
            leaf.append(cell)
            used, before = used + len(cell) + 2, rowid
        if not pages:
            return self.root(13, leaf, 0, root)
        pages.append(self.add(self.node(13, leaf)))
        last.append(before)
        return self.over_table(pages, last, root)

    def index(self, df: DataFrame, rows) -> int:
        """The tree of a sorted frame whose batches rows turns into entries; gives the root."""
        size = self.size
        blocks = self.blocks(df.mapInArrow(lambda batches: Part(size).index(rows(batches)), Part.DDL))
        children, cells, pending = array("q"), [], []

        def join(last: bool) -> None:
            """Leaves of the cells between two parts' leaves; what follows needs an entry before it, the end a leaf."""
            nodes, between, leaf, used = [], [], [], 0
            for c in pending:
                if used + len(c) + 2 > self.room(True):
                    nodes.append(leaf)
                    between.append(c)
                    leaf, used = [], 0
                else:
                    leaf.append(c)
                    used += len(c) + 2
            if last and not leaf:
                leaf = [between.pop()]
                between.append(nodes[-1].pop())
            if not last and len(leaf) == 1:
                leaf.insert(0, between.pop())
                between.append(nodes[-1].pop())
            if not last and leaf:
                between.append(leaf.pop())
            if leaf:
                nodes.append(leaf)
            children.extend(self.add(self.node(10, n)) for n in nodes)
            cells.extend(between)
            pending.clear()

        for r in blocks.rows:
            base = blocks.at[r["part"]]
            own = [c[:-4] + struct.pack(">I", struct.unpack(">I", c[-4:])[0] + base) if f else bytes(c) for c, f in zip(r["cells"], r["far"])]
            if r["kind"] != Part.BLOCK:
                pending += own
            elif own:
                if pending:
                    join(False)
                children.extend(base + n for n in array("q", r["leaves"]))
                cells += own
        if not pending:
            return self.root(10, [], 0, False)
        join(True)
        return self.over_index(children, cells)

    def over_index(self, children, cells: list[bytes]) -> int:
        """Inner nodes over the leaves of an index, given the entries between them."""
        while len(children) > 1:
            up, dividers, start, i, used = array("q"), [], 0, 0, 0
            room = self.room(False)
            node = lambda start, i: self.add(self.node(2, [struct.pack(">I", children[j]) + cells[j] for j in range(start, i)], children[i]))
            while i < len(cells):
                if used + len(cells[i]) + 6 > room and i > start:
                    if i == len(cells) - 1:
                        i -= 1  # what stands between two nodes needs a node after it
                    up.append(node(start, i))
                    dividers.append(cells[i])
                    start, used, i = i + 1, 0, i + 1
                    continue
                used += len(cells[i]) + 6
                i += 1
            up.append(node(start, len(cells)))
            cells, children = dividers, up
        return children[0]

    def root(self, kind: int, cells: list[bytes], right: int, first: bool) -> int:
        if first:
            self.pieces[0][0] = self.node(kind, cells, right, 100)
            return 1
        return self.add(self.node(kind, cells, right))

    def header(self, user_version: int, application_id: int) -> bytes:
        head = MAGIC + struct.pack(">HBBBBBB", self.size & 0xFFFF if self.size < 65536 else 1, 1, 1, 0, 64, 32, 32)
        head += struct.pack(">II", 1, self.count) + struct.pack(">II", 0, 0) + struct.pack(">II", 1, 4) + struct.pack(">II", 0, 0) + struct.pack(">I", 1)
        head += struct.pack(">i", user_version) + struct.pack(">I", 0) + struct.pack(">i", application_id) + bytes(20) + struct.pack(">II", 1, 3_040_000)
        assert len(head) == 100
        return head

    def write(self, spark, out) -> None:
        """The pieces in their order to a stream of the JVM."""
        io, Path = spark._jvm.org.apache.commons.io.IOUtils, spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        for piece in self.pieces:
            if not isinstance(piece, Blocks):
                step = max(1, (1 << 20) // self.size)
                for i in range(0, len(piece), step):
                    out.write(bytearray(b"".join(piece[i : i + step])))
                continue
            if not piece.count:
                continue
            folder, sizes = piece.streamed(self.size)
            at, fs = iter(sizes), Path(folder).getFileSystem(conf)
            files = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(Path(folder)))
            for name, length in files:
                if not name.startswith("part-") or not length:
                    continue
                source = fs.open(Path(f"{folder}/{name}"))
                while length:
                    n = next(at)
                    if io.copyLarge(source, out, 0, n) != n:
                        raise SqlError("pages of the image are missing")
                    source.read()  # the end of the line
                    length -= n + 1
                source.close()
            if next(at, None) is not None:
                raise SqlError("pages of the image are missing")
            fs.delete(Path(folder), True)
            fs.delete(Path(piece.df.scratch_path), True)


def _column_sql(c, t: Table) -> str:
    out = [text.quoted(c.label)]
    if c.declared:
        out.append(c.declared)
    if c.label == t.rowid_alias:
        out.append("PRIMARY KEY AUTOINCREMENT" if t.autoincrement else "PRIMARY KEY")
    if c.coll and c.coll != "BINARY":
        out.append(f"COLLATE {c.coll}")
    if c.notnull and not (t.without_rowid and c.pk):
        out.append("NOT NULL" + ("" if c.notnull == "abort" else f" ON CONFLICT {c.notnull.upper()}"))
    if c.default is not None:
        out.append(f"DEFAULT ({text.expression(c.default)})")
    if c.generated is not None:
        out.append(f"AS ({text.expression(c.generated)}) {'STORED' if c.stored else 'VIRTUAL'}")
    return " ".join(out)


def _terms(k: Key) -> str:
    return ", ".join(text.expression(e) + (" DESC" if i < len(k.desc) and k.desc[i] else "") for i, e in enumerate(k.terms))


def table_sql(t: Table) -> str:
    """A CREATE TABLE statement: columns, the primary key, unique keys in their order, checks."""
    parts = [_column_sql(c, t) for c in t.columns]
    for k in t.keys:
        if k.origin in ("pk", "u") and not (k.origin == "pk" and t.rowid_alias):
            policy = "" if k.policy == "abort" else f" ON CONFLICT {k.policy.upper()}"
            parts.append(f"{'PRIMARY KEY' if k.origin == 'pk' else 'UNIQUE'} ({_terms(k)}){policy}")
    parts += [(f"CONSTRAINT {text.quoted(label)} " if label else "") + f"CHECK ({text.expression(e)})" for label, e in t.checks]
    options = [o for o, on in (("WITHOUT ROWID", t.without_rowid), ("STRICT", t.strict)) if on]
    return f"CREATE TABLE {text.quoted(t.name)} ({', '.join(parts)})" + (" " + ", ".join(options) if options else "")


def _key_columns(t: Table, k: Key) -> list[tuple[object, str | None]]:
    """The collation of each term."""
    out = []
    for e in k.terms:
        coll = e.name.upper() if e.kind == "collate" else None
        of = e.of if e.kind == "collate" else e
        column = next((c for c in t.columns if of.kind == "name" and c.label.lower() == of.name.lower()), None)
        out.append((column, coll or (column.coll if column is not None else None)))
    return out


def _sent(sql: str, ty: str) -> str:
    """A value on its way to a task: texts as bytes, which a task takes as they are."""
    if ty in ("int", "real", "blob"):
        return sql
    if ty == "bool":
        return f"CAST({sql} AS BIGINT)"
    if ty == "cell":
        return f"CASE WHEN {sql} IS NOT NULL THEN named_struct('t', ({sql}).t, 'i', ({sql}).i, 'd', ({sql}).d, 's', CAST(({sql}).s AS BINARY), 'b', ({sql}).b) END"
    return f"CAST(CAST({sql} AS STRING) AS BINARY)"


def _got(values: list, ty: str) -> list:
    """Values of a column as they stand in records."""
    if ty in ("int", "bool", "blob"):
        return values
    if ty == "real":
        return [None if v is None else float(v) for v in values]
    if ty == "cell":
        place = {"integer": "i", "real": "d", "text": "s", "blob": "b"}
        return [None if v is None else Text(v["s"]) if v["t"] == "text" else v[place[v["t"]]] for v in values]
    return [None if v is None else Text(v) for v in values]


def _entries(kinds: list[str]):
    def rows(batches):
        for batch in batches:
            yield from zip(*(_got(c.to_pylist(), k) for c, k in zip(batch.columns, kinds)))

    return rows


def _records(kinds: list[str], alias: int | None):
    """(rowid, values) of rows that begin with their rowid; the column that stands for the rowid is NULL."""

    def rows(batches):
        for batch in batches:
            columns = [_got(c.to_pylist(), k) for c, k in zip(batch.columns[1:], kinds)]
            if alias is not None:
                columns[alias] = [None] * batch.num_rows
            yield from zip(batch.column(0).to_pylist(), zip(*columns))

    return rows


def laid(con: Connection, page_size: int = 4096) -> Pages:
    """The image of all tables that the connection made, with their views and indexes; the header stands apart."""
    pages, schema = Pages(page_size), []

    def index(view: str, cells: list[E], colls: list, desc: list[bool], where: str, keep: list[int]) -> int:
        """A tree of the rows' cells, sorted as the dialect sorts them. keep: those that entries hold."""
        cols = ", ".join(f"{_sent(S.out(cells[i]), cells[i].ty)} AS c{i}" for i in keep)
        order = [f"{S.key(E(S.out(c), c.ty), coll)} {'DESC NULLS LAST' if d else 'ASC NULLS FIRST'}" for c, coll, d in zip(cells, colls, [*desc, *[False] * len(cells)])]
        df = con.spark.sql(f"SELECT {cols} FROM {view} i{where} ORDER BY {', '.join(order)}")
        return pages.index(df, _entries([cells[i].ty for i in keep]))

    sequences = []
    for t in con.catalog.tables.values():
        if t.fixed:
            continue
        stored = [c for c in t.columns if c.generated is None or c.stored]
        pk = next((k for k in t.keys if k.origin == "pk"), None)
        cell = lambda c: E(f"i.`{c.label}`", c.ty, c.aff, c.coll)
        rest: list = []
        t.df.createOrReplaceTempView("sedge_image")
        if t.without_rowid:
            first = [c for c, _ in _key_columns(t, pk)]
            ordered = [*first, *[c for c in stored if all(c is not f for f in first)]]
            colls = [coll for _, coll in _key_columns(t, pk)]
            root = index("sedge_image", [cell(c) for c in ordered], colls, list(pk.desc), "", list(range(len(ordered))))
        else:
            cols = "".join(f", {_sent(f'i.`{c.label}`', c.ty)} AS c{i}" for i, c in enumerate(stored))
            alias = next((i for i, c in enumerate(stored) if c.label == t.rowid_alias), None)
            root = pages.table(con.spark.sql(f"SELECT i.`{ROWID}`{cols} FROM sedge_image i ORDER BY i.`{ROWID}`"), _records([c.ty for c in stored], alias))
        schema.append(("table", t.name, t.name, root, table_sql(t)))
        if t.autoincrement:
            sequences.append((t.name, con._high(t)))
        own = [k for k in t.keys if k.origin in ("pk", "u") and not (k.origin == "pk" and (t.rowid_alias or t.without_rowid))]
        count = 1 if t.without_rowid else 0
        for k in [*own, *[k for k in t.keys if k.origin == "c"]]:
            t.df.createOrReplaceTempView("sedge_image")
            low, scope = con.lowering(), con._scope(t, "i")
            cells = [low.expr(e.of if e.kind == "collate" else e, scope) for e in k.terms]
            where = f" WHERE {S.truth(low.expr(k.where, scope))}" if k.where is not None else ""
            kinds = _key_columns(t, k)
            colls = [coll for _, coll in kinds] + ([coll for _, coll in _key_columns(t, pk)] if t.without_rowid else [None])
            tail = [cell(c) for c, _ in _key_columns(t, pk)] if t.without_rowid else [E(f"i.`{ROWID}`", "int", "int")]
            keep = list(range(len(kinds) + len(tail)))
            if t.without_rowid:  # key columns that the index holds already are not repeated
                held = [c for c, _ in kinds]
                keep = list(range(len(kinds))) + [len(kinds) + j for j, (c, _) in enumerate(_key_columns(t, pk)) if all(c is not h for h in held)]
            at = index("sedge_image", [*cells, *tail], colls, list(k.desc), where, keep)
            if k.origin == "c":
                sql = f"CREATE {'UNIQUE ' if k.unique else ''}INDEX {text.quoted(k.name)} ON {text.quoted(t.name)} ({_terms(k)})" + (f" WHERE {text.expression(k.where)}" if k.where is not None else "")
                rest.append(("index", k.name, t.name, at, sql))
            else:
                count += 1
                rest.append(("index", f"sqlite_autoindex_{t.name}_{count}", t.name, at, None))
        schema += rest
    if sequences:
        root = pages.table_tree((i, record(s)) for i, s in enumerate(sequences, 1))
        schema.append(("table", "sqlite_sequence", "sqlite_sequence", root, "CREATE TABLE sqlite_sequence(name,seq)"))
    for v in con.catalog.views.values():
        schema.append(("view", v.name, v.name, 0, v.sql))
    pages.table_tree(((i, record(r)) for i, r in enumerate(schema, 1)), root=True)
    pages.pieces[0][0] = pages.header(con.catalog.values.get("user_version", 0), con.catalog.values.get("application_id", 0)) + pages.pieces[0][0]
    return pages


def export(con: Connection, path: str, page_size: int = 4096) -> None:
    """Writes the image to path, on any file system that Spark reaches; a file that is there already is an error."""
    if con.saves:
        raise SqlError("finish the transaction before saving an image")
    p = con.spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(con.spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        raise SqlError(f"there is a file at {path} already")
    pages = laid(con, page_size)
    out = fs.create(p, False)
    try:
        pages.write(con.spark, out)
    except BaseException:
        out.close()
        fs.delete(p, False)
        raise
    out.close()
