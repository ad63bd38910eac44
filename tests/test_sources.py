"""Database images made by Python's own library, streams against batches, the command line."""

import random
import sqlite3

import pytest

from sedge.sources.image import Image, ImageError, attach, varint
from sedge.sql.connection import Connection


def image(path, page=512, encoding="UTF-8"):
    con = sqlite3.connect(path)
    con.executescript(f"PRAGMA page_size={page}; PRAGMA encoding='{encoding}'; PRAGMA user_version=7;")
    con.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT, n INT, r REAL, b BLOB)")
    con.execute("CREATE TABLE w(k TEXT, v INT, j INT, PRIMARY KEY (j, k)) WITHOUT ROWID")
    con.execute("CREATE VIEW v AS SELECT a, n FROM t WHERE n > 50")
    r = random.Random(1)
    rows = [(i * 3, "é" * r.randint(0, 900), r.choice([None, 0, 1, -5, 300, 70_000, -(1 << 40), (1 << 62)]), r.choice([None, 0.5, -1e300]), bytes(r.choices(range(256), k=r.randint(0, 700)))) for i in range(300)]
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    con.executemany("INSERT INTO w VALUES (?, ?, ?)", [(f"k{i}", i, i % 5) for i in range(400)])
    con.commit()
    want = con.execute("SELECT * FROM t ORDER BY id").fetchall(), con.execute("SELECT * FROM w ORDER BY j, k").fetchall(), con.execute("SELECT count(*) FROM v").fetchall()
    con.close()
    return want


@pytest.mark.parametrize("page, encoding", [(512, "UTF-8"), (4096, "UTF-16le"), (65536, "UTF-16be")])
def test_attach_reads_every_table(spark, tmp_path, page, encoding):
    path = str(tmp_path / "x.db")
    t, w, v = image(path, page, encoding)
    con = Connection(spark)
    assert set(attach(con, f"file://{path}")) == {"t", "w", "v"}
    assert con.execute("SELECT * FROM t ORDER BY id").rows() == [(*x[:4], bytearray(x[4])) for x in t]
    assert con.execute("SELECT * FROM w ORDER BY j, k").rows() == w
    assert con.execute("SELECT count(*) FROM v").rows() == v


def test_damaged_images_raise(tmp_path):
    path = tmp_path / "x.db"
    image(str(path))
    data = path.read_bytes()
    with pytest.raises(ImageError):
        Image(b"nothing" * 100)
    r = random.Random(3)
    for _ in range(150):
        b = bytearray(data)
        for _ in range(8):
            b[r.randrange(len(b))] = r.randrange(256)
        try:
            i = Image(bytes(b))
            for kind, _, _, root, _ in i.schema():
                if kind == "table" and isinstance(root, int):
                    list(i.rows(root))
        except (ImageError, IndexError, ValueError, TypeError, OverflowError, Exception) as e:  # any error, but an end
            assert not isinstance(e, (MemoryError, RecursionError))


@pytest.mark.parametrize("raw, n", [(b"\x00", 0), (b"\x7f", 127), (b"\x81\x00", 128), (b"\xff" * 9, -1), (b"\x81\x80\x00", 1 << 14)])
def test_varints(raw, n):
    assert varint(raw + b"\0", 0) == (n, len(raw))


LITERALS = ["NULL", "0", "1", "-1", "2.5", "'12'", "'2.5x'", "'bad'", "7", "-3", "1000000", "''"]
OPERATORS = ["+", "-", "*", "/", "%", "||", "&", "|", "<<", ">>", "=", "<>", "<", "<=", ">", ">=", "AND", "OR", "IS", "IS NOT"]


def test_random_expressions_agree(spark):
    """Seeded binary expressions over literals of every class, against the embedded database of the standard library."""
    r, other = random.Random(8), sqlite3.connect(":memory:")
    exprs = [f"({r.choice(LITERALS)} {r.choice(OPERATORS)} {r.choice(LITERALS)})" for _ in range(240)]
    exprs += [f"({a} {r.choice(OPERATORS)} {b})" for a, b in zip(exprs[:40], exprs[40:80])]
    con = Connection(spark)
    for i in range(0, len(exprs), 40):
        part = exprs[i : i + 40]
        got = con.execute("SELECT " + ", ".join(part)).rows()[0]
        want = other.execute("SELECT " + ", ".join(part)).fetchone()
        for e, a, b in zip(part, got, want):
            assert a == b or isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) < 1e-9 * max(1, abs(b)), (e, a, b)


@pytest.mark.parametrize("s", ["abc🦀", "hello", ""])
def test_substr_grid_agrees(spark, s):
    other = sqlite3.connect(":memory:")
    cells = [f"substr('{s}', {a}, {b})" for a in range(-7, 8) for b in range(-6, 7)] + [f"substr('{s}', {a})" for a in range(-7, 8)]
    sql = "SELECT " + ", ".join(cells)
    assert Connection(spark).execute(sql).rows() == other.execute(sql).fetchall()


def test_streams_match_batches(spark, sf, tmp_path):
    from sedge.streaming.events import read_events, sessions, windowed

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "events"))
    for build, name in ((windowed, "w"), (sessions, "s")):
        mode = "complete" if name == "w" else "append"
        q = build(read_events(spark, str(tmp_path / "events"))).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        streamed = spark.sql(f"SELECT sum(n) FROM {name}").first()[0] or 0
        assert 0 < streamed <= batch.count()
        if name == "w":
            assert sorted(map(str, spark.sql("SELECT * FROM w").collect())) == sorted(map(str, windowed(batch).collect()))


def test_command_line(sf):
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-m", "sedge", "--tables", sf], input="SELECT count(*) AS n FROM nation; VALUES (x'0a', NULL, 1.5)", capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0], timeout=200)
    assert out.stdout.splitlines()[-2:] == ['{"columns": ["n"], "rows": [[{"integer": 25}]], "changes": 0}', '{"columns": ["column1", "column2", "column3"], "rows": [[{"blob": "0a"}, {"null": null}, {"real": 1.5}]], "changes": 0}']


def filled(spark):
    con = Connection(spark)
    con.execute_batch(
        "CREATE TABLE t(id INTEGER PRIMARY KEY AUTOINCREMENT, a TEXT COLLATE NOCASE UNIQUE, n INT DEFAULT (1 + 2) CHECK (n > 0), r REAL, b BLOB, g INT AS (n * 2) STORED);"
        "CREATE TABLE w(k TEXT, v INT, j INT, PRIMARY KEY (j DESC, k)) WITHOUT ROWID; CREATE TABLE u(x);"
        "CREATE INDEX ix ON t(n DESC, lower(a)) WHERE n > 5; CREATE UNIQUE INDEX iw ON w(v); CREATE VIEW big AS SELECT a, n FROM t WHERE n > 50; PRAGMA user_version = 42"
    )
    rows = ", ".join(f"('Name{i}', {i % 60 + 1}, {i}.0, x'{'ab' * (i % 7)}')" for i in range(400))
    con.execute(f"INSERT INTO t(a, n, r, b) VALUES {rows}")
    con.execute("INSERT INTO t(a, n) VALUES ('" + "long " * 2000 + "', 9)")
    con.execute("INSERT INTO w SELECT 'k' || id, id, id % 5 FROM t")
    con.execute_batch("INSERT INTO u VALUES (1), ('x'); INSERT INTO u VALUES (2.5), (NULL), (x'00ff')")
    return con


@pytest.mark.parametrize("page", [512, 4096])
def test_images_written_are_read_by_the_embedded_database(spark, tmp_path, page):
    from sedge.sources.image_writer import export

    con, path = filled(spark), str(tmp_path / "out.db")
    export(con, f"file://{path}", page)
    m = sqlite3.connect(path)
    assert m.execute("PRAGMA integrity_check").fetchall() == [("ok",)]
    assert m.execute("PRAGMA user_version").fetchall() == [(42,)]
    for q in ("SELECT id, a, n, r, g FROM t ORDER BY id", "SELECT k, v, j FROM w ORDER BY v", "SELECT count(*), sum(n) FROM big", "SELECT hex(b) FROM t ORDER BY id"):
        assert m.execute(q).fetchall() == con.execute(q).rows(), q
    assert m.execute("SELECT typeof(x), quote(x) FROM u").fetchall() == [("integer", "1"), ("text", "'x'"), ("real", "2.5"), ("null", "NULL"), ("blob", "X'00FF'")]
    assert m.execute("SELECT seq FROM sqlite_sequence").fetchall() == [(401,)]
    with pytest.raises(sqlite3.IntegrityError):
        m.execute("INSERT INTO t(a) VALUES ('name7')")
    m.execute("INSERT INTO t(a) VALUES ('fresh')")
    assert m.execute("SELECT id, n FROM t WHERE a = 'fresh'").fetchall() == [(402, 3)]
    m.close()
    again = Connection(spark)
    attach(again, f"file://{path}")
    assert again.execute("SELECT count(*), sum(g) FROM t").rows() == con.execute("SELECT count(*), sum(g) FROM t").rows()
    with pytest.raises(Exception):
        export(con, f"file://{path}", page)


def test_logs_are_laid_over_their_image(tmp_path):
    import shutil

    from sedge.inspect import lines, opened
    from sedge.sources.image import recovered

    path = str(tmp_path / "live.db")
    m = sqlite3.connect(path, isolation_level=None)
    m.execute("PRAGMA journal_mode=WAL")
    m.execute("PRAGMA wal_autocheckpoint=0")
    m.execute("CREATE TABLE t(a, b)")
    m.executemany("INSERT INTO t VALUES (?, ?)", [(i, "x" * i) for i in range(300)])
    copy, log = str(tmp_path / "copy.db"), str(tmp_path / "copy.log")
    shutil.copy(path, copy)
    shutil.copy(path + "-wal", log)
    data, frames = open(copy, "rb").read(), open(log, "rb").read()
    whole = Image(recovered(data, frames))
    root = next(r for k, n, _, r, _ in whole.schema() if n == "t")
    assert [v[0] for _, v in whole.rows(root)] == list(range(300))
    cut = Image(recovered(data, frames[:-40]))  # the last commit is torn
    assert [v[0] for _, v in cut.rows(root)] == list(range(299))
    bad = bytearray(frames)
    bad[24] ^= 1
    with pytest.raises(ImageError):
        recovered(data, bytes(bad))
    with pytest.raises(ImageError):
        opened(path)
    got = list(lines([copy, "rows", str(root), "--wal", log]))
    assert len(got) == 300 and got[2] == {"rowid": 3, "values": [{"integer": 2}, {"text": "xx"}]}
    assert list(lines([copy, "info", "--wal", log]))[0]["encoding"] == "utf-8" and [x["name"] for x in lines([copy, "schema", "--wal", log])] == ["t"]
    m.close()


@pytest.mark.parametrize("page, parts", [(512, 3), (512, 200), (4096, 7)])
def test_images_written_and_read_in_parts(spark, tmp_path, monkeypatch, page, parts):
    """Trees that many tasks made, chains and entries at their borders; a file read by pages is what it is as a whole."""
    from sedge.sources import image as reading
    from sedge.sources import image_writer as writing

    con, path = filled(spark), str(tmp_path / "out.db")
    with monkeypatch.context() as m:
        m.setattr(writing, "BLOCK", 2048)
        before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            con.execute("CREATE INDEX wide ON t(a COLLATE RTRIM DESC, b)")
            writing.export(con, f"file://{path}", page)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    m = sqlite3.connect(path)
    assert m.execute("PRAGMA integrity_check").fetchall() == [("ok",)]
    for q in ("SELECT id, a, n, r, g FROM t ORDER BY id", "SELECT k, v, j FROM w ORDER BY v"):
        assert m.execute(q).fetchall() == con.execute(q).rows(), q
    m.close()
    monkeypatch.setattr(reading, "WHOLE", 0)
    monkeypatch.setattr(reading, "SPLIT", 8192)
    again = Connection(spark)
    attach(again, f"file://{path}")
    for q in ("SELECT id, a, n, r, b, g FROM t ORDER BY id", "SELECT k, v, j FROM w ORDER BY v"):
        assert again.execute(q).rows() == con.execute(q).rows(), q


@pytest.mark.parametrize("page, encoding", [(512, "UTF-8"), (65536, "UTF-16be")])
def test_attach_reads_large_files_by_pages(spark, tmp_path, monkeypatch, page, encoding):
    from sedge.sources import image as reading

    path = str(tmp_path / "a,b [1].db")
    t, w, v = image(path, page, encoding)
    monkeypatch.setattr(reading, "WHOLE", 0)
    monkeypatch.setattr(reading, "SPLIT", 8192)
    con = Connection(spark)
    attach(con, f"file://{path}".replace("[", "\\[").replace("]", "\\]"))
    assert con.execute("SELECT * FROM t ORDER BY id").rows() == [(*x[:4], bytearray(x[4])) for x in t]
    assert con.execute("SELECT * FROM w ORDER BY j, k").rows() == w


def test_images_are_not_bounded(spark, tmp_path):
    """More than 256 MB, which one process on the driver used to be held to."""
    from sedge.sources.image_writer import export

    con, path = Connection(spark), str(tmp_path / "large.db")
    con.register("n", spark.range(270, numPartitions=20).selectExpr("id", "repeat(chr(CAST(97 + id % 26 AS INT)), 1000000) AS s"), order="id")
    con.execute_batch("CREATE TABLE t(id INTEGER PRIMARY KEY, s TEXT); INSERT INTO t SELECT id, s FROM n; CREATE INDEX i ON t(substr(s, 1, 1))")
    export(con, f"file://{path}")
    m = sqlite3.connect(path)
    assert m.execute("PRAGMA integrity_check").fetchall() == [("ok",)]
    want = m.execute("SELECT count(*), sum(length(s)), sum(id * (s = replace(hex(zeroblob(500000)), '0', char(97 + id % 26)))) FROM t").fetchall()
    m.close()
    assert want == [(270, 270_000_000, sum(range(270)))]
    again = Connection(spark)
    attach(again, f"file://{path}")
    assert again.execute("SELECT count(*), sum(length(s)), sum(id * (s = replace(hex(zeroblob(500000)), '0', char(97 + id % 26)))) FROM t").rows() == want
