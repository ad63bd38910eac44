"""Semantics that SQL engines differ in, with the results written out."""

import pytest

from sedge.sql.connection import Connection, ConstraintError
from sedge.sql.lexer import SqlError
from sedge.sql.parser import parse


@pytest.fixture()
def con(spark):
    return Connection(spark)


def one(con, sql, params=None):
    return tuple(con.execute(sql, params).rows()[0])


def rows(con, sql, params=None):
    return con.execute(sql, params).rows()


@pytest.mark.parametrize(
    "sql, want",
    [
        ("7/2, -7/2, 7%-2, 1/0, 5%0", (3, -3, 1, None, None)),
        ("NULL AND 0, NULL OR 1, NOT NULL, 'abc' OR 0, '1x' AND 1", (0, 1, None, 0, 1)),
        ("1 << 65, 1 << -1, -8 >> 1, -1 >> 99, ~0", (0, 0, -4, -1, -1)),
        ("'a' || 1 || 2.0, NULL || 'x'", ("a12.0", None)),
        ("substr('hello', 0, 2), substr('hello', 3, -2), substr('hello', -2), substr('hello', 9)", ("h", "he", "lo", "")),
        ("'B' = 'b' COLLATE NOCASE, 'a  ' = 'a' COLLATE RTRIM, 'É' = 'é' COLLATE NOCASE", (1, 1, 0)),
        ("'ÄB' LIKE 'äb', 'ab' LIKE 'A_', '10%' LIKE '10!%' ESCAPE '!', 'Abc' GLOB 'a*'", (0, 1, 1, 0)),
        ("1 IN (2, NULL), 1 IN (), NULL IN (), 2 NOT IN (1, NULL)", (None, 0, 0, None)),
        ("(1, NULL) = (2, NULL), (1, NULL) = (1, NULL), (1, 2) < (1, 3), (NULL, 1) IS (NULL, 1)", (0, None, 1, 1)),
        ("CAST('0x1' AS INTEGER), CAST(' 12abc' AS INTEGER), CAST('1e2' AS REAL), CAST(9.9e18 AS INTEGER)", (0, 12, 100.0, 9223372036854775807)),
        ("typeof(1), typeof(1.0), typeof('1'), typeof(x'31'), typeof(NULL), typeof(1 = 1)", ("integer", "real", "text", "blob", "null", "integer")),
        ("max(1, NULL), min(3, 1, 2), max('a', 'B'), iif(NULL, 1), iif(0, 1, 1, 2)", (None, 1, "a", None, 2)),
        ("1 < 'a', 'a' < x'00', x'61' = 'a', 1 = '1'", (1, 1, 0, 0)),
        ("hex(char(0x1F600)), unicode('é'), length('a'), trim('--a-', '-')", ("F09F9880", 233, 1, "a")),
        ("9007199254740993 > 9007199254740992.0, 9007199254740993 = 9007199254740992.0", (1, 0)),
        ("5 BETWEEN 1 AND NULL, 0 BETWEEN 1 AND NULL, CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", (None, 0, "b")),
        ("0x10, 1_000, .5, x'ff' IS NOT NULL, -9223372036854775808", (16, 1000, 0.5, 1, -9223372036854775808)),
        ("NOT 1 = 2, - 2 - -3, 2 + 3 * 4, 10 - 4 - 3, 1 = 1 = 1", (1, 1, 14, 3, 1)),
    ],
)
def test_expressions(con, sql, want):
    assert one(con, f"SELECT {sql}") == want


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT", "SELECT 1 FROM", "SELECT nope", "SELECT 1 HAVING 1", "SELECT sum(sum(1))", "SELECT count(*) FROM (SELECT 1 a) WHERE count(*) > 0", "SELECT (1, 2)", "SELECT (1, 2) = (1, 2, 3)",
        "SELECT 1 UNION SELECT 1, 2", "WITH a AS (SELECT 1), a AS (SELECT 2) SELECT 1", "SELECT x FROM (SELECT 1 x), (SELECT 2 x)", "SELECT nofn(1)", "SELECT 1 LIMIT 'x'", "SELECT abs()", "SELECT 'abc",
        "SELECT DISTINCT group_concat(DISTINCT 1, 2)", "SELECT * ", "SELECT 1 ORDER BY 2", "WITH c(x) AS (SELECT x FROM c) SELECT * FROM c", "SELECT 1 FROM (SELECT 1 a) t NATURAL JOIN (SELECT 1 a) u ON 1", "PRAGMA nothing",
    ],
)
def test_errors(con, sql):
    with pytest.raises(SqlError):
        con.execute(sql).rows()


def test_parser_survives_any_damage():
    """Cut and changed statements either parse or raise SqlError, never anything else."""
    import random

    r = random.Random(5)
    base = "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x+1 FROM c WHERE x < 5) SELECT a.*, count(*) FILTER (WHERE b IN (1,2)) FROM t a LEFT JOIN u USING (k) GROUP BY 1 HAVING sum(x) > 2 ORDER BY 1 DESC NULLS LAST LIMIT 3;"
    for _ in range(2000):
        s = list(base)
        for _ in range(r.randint(1, 6)):
            i = r.randrange(len(s))
            s[i : i + r.randint(0, 3)] = r.choice(["", "(", ")", "'", " ", ",", "select", "\x00", "é", "1e", "/*", "--"])
        try:
            parse("".join(s))
        except SqlError:
            pass


def test_parameters(con):
    assert one(con, "SELECT ?1 + ?2, ?, :a || :a", [1, 2, 3, "x"]) == (3, 3, "xx")
    assert one(con, "SELECT :v, @w", {"v": 4, "@w": "q"}) == (4, "q")
    assert one(con, "SELECT ?5") == (None,)
    with pytest.raises(SqlError):
        con.execute("SELECT 1", [1])


def test_group_concat_orders_and_separators(con):
    t = "WITH t(g, x, k, keep) AS (VALUES (1, 'b', 2, 0), (1, 'A', 1, 1), (1, 'a', 3, NULL), (2, 'y', 1, 1), (2, 'b', 2, 1))"
    assert one(con, t + " SELECT group_concat(x ORDER BY k DESC, x) FROM t WHERE g = 1") == ("a,b,A",)
    assert one(con, t + " SELECT string_agg(x, k ORDER BY k DESC) FROM t WHERE g = 1") == ("a2b1A",)
    assert one(con, t + " SELECT group_concat(DISTINCT x COLLATE NOCASE), count(DISTINCT x COLLATE NOCASE) FROM t") == ("A,b,y", 3)
    assert one(con, t + " SELECT count(*) FILTER (WHERE keep), total(k) FILTER (WHERE NULL), group_concat(x) FILTER (WHERE 0) FROM t") == (3, 0.0, None)


def test_set_operators_bind_equally(con):
    assert rows(con, "SELECT 2 UNION SELECT 1 INTERSECT SELECT 1") == [(1,)]
    assert rows(con, "SELECT NULL UNION SELECT NULL") == [(None,)]


def test_using_merges(con):
    a, b = "(SELECT 1 k, 'a' x UNION ALL SELECT 2, 'b') a", "(SELECT 2 k, 'c' y UNION ALL SELECT 3, 'd') b"
    assert sorted(rows(con, f"SELECT k, a.k, b.k, x, y FROM {a} FULL JOIN {b} USING (k)"), key=str) == [(1, 1, None, "a", None), (2, 2, 2, "b", "c"), (3, None, 3, None, "d")]
    assert con.execute(f"SELECT * FROM {a} JOIN {b} USING (k)").columns == ["k", "x", "y"]
    assert sorted(rows(con, f"SELECT k FROM {a} RIGHT JOIN {b} USING (k)")) == [(2,), (3,)]


def test_recursion_with_cycles_nulls_and_order(con):
    assert sorted(rows(con, "WITH RECURSIVE c(x) AS (SELECT 1 UNION SELECT (x % 3) + 1 FROM c) SELECT x FROM c")) == [(1,), (2,), (3,)]
    assert rows(con, "WITH RECURSIVE c(x) AS (SELECT NULL UNION SELECT x FROM c) SELECT x FROM c") == [(None,)]
    assert one(con, "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 200) SELECT count(*), max(x) FROM c") == (200, 200)


def test_policies(con):
    con.execute_batch("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT UNIQUE, n NUMERIC NOT NULL DEFAULT 9 CHECK (n > 0)); INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2)")
    for bad in ("INSERT INTO t VALUES (3, 'a', 1)", "INSERT INTO t VALUES (3, 'c', 0)", "INSERT INTO t VALUES (3, 'c', NULL)", "INSERT INTO t(a) VALUES ('z'), ('z')", "UPDATE t SET a = 'a'"):
        with pytest.raises(ConstraintError):
            con.execute(bad)
        assert rows(con, "SELECT * FROM t ORDER BY id") == [(1, "a", 1), (2, "b", 2)]
    assert con.execute("INSERT OR IGNORE INTO t VALUES (1, 'q', 1), (5, 'e', 5), (6, 'e', 6)").changes == 1
    assert con.execute("INSERT OR REPLACE INTO t VALUES (7, 'a', NULL)").changes == 1
    assert rows(con, "SELECT id, a, n FROM t ORDER BY id") == [(2, "b", 2), (5, "e", 5), (7, "a", 9)]
    with pytest.raises(ConstraintError):
        con.execute("INSERT OR FAIL INTO t VALUES (8, 'h', 1), (9, 'a', 1), (10, 'j', 1)")
    assert rows(con, "SELECT id FROM t ORDER BY id") == [(2,), (5,), (7,), (8,)]


def test_upsert_sees_earlier_rows_of_its_own_batch(con):
    con.execute_batch("CREATE TABLE c(w TEXT PRIMARY KEY, n INT)")
    con.execute("INSERT INTO c VALUES ('a', 1), ('b', 1), ('a', 1), ('a', 1) ON CONFLICT(w) DO UPDATE SET n = n + excluded.n")
    assert rows(con, "SELECT w, n FROM c ORDER BY w") == [("a", 3), ("b", 1)]


def test_transactions_nest(con):
    con.execute_batch("CREATE TABLE t(x INT); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2); SAVEPOINT s; DELETE FROM t; ROLLBACK TO s")
    assert one(con, "SELECT count(*) FROM t") == (2,)
    con.execute("ROLLBACK")
    assert one(con, "SELECT count(*) FROM t") == (1,)
    with pytest.raises(SqlError):
        con.execute("COMMIT")


def test_alter_and_checks(con):
    con.execute_batch("CREATE TABLE t(a INT, b TEXT); INSERT INTO t VALUES (1, 'x'); CREATE VIEW v AS SELECT b, a FROM t")
    con.execute_batch("ALTER TABLE t ADD COLUMN c INT DEFAULT 5; ALTER TABLE t RENAME COLUMN a TO z; ALTER TABLE t ADD CONSTRAINT pos CHECK (z > 0)")
    assert rows(con, "SELECT * FROM v") == [("x", 1)]
    with pytest.raises(ConstraintError):
        con.execute("INSERT INTO t VALUES (-1, 'y', 1)")
    con.execute_batch("ALTER TABLE t DROP CONSTRAINT pos; ALTER TABLE t ALTER COLUMN b SET NOT NULL; ALTER TABLE t DROP COLUMN c")
    with pytest.raises(ConstraintError):
        con.execute("INSERT INTO t VALUES (-1, NULL)")


def test_views_are_lazy_and_not_circular(con):
    con.execute("CREATE VIEW late AS SELECT x FROM later")
    con.execute_batch("CREATE TABLE later(x INT); INSERT INTO later VALUES (4)")
    assert rows(con, "SELECT x FROM late") == [(4,)]
    con.execute("CREATE VIEW loop AS SELECT * FROM loop")
    with pytest.raises(SqlError):
        con.execute("SELECT * FROM loop")


def test_filters_and_columns_reach_the_scan(spark, sf):
    from sedge.plans.catalogue import connect

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = connect(spark, sf).sql("SELECT l_orderkey FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_quantity < 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_quantity" in plan and "l_comment" not in plan


def test_exclude_against_the_embedded_database(con, spark):
    import sqlite3

    values = "(1, 'a', 1, 10, 1.5), (2, 'a', 1, NULL, 2.5), (3, 'a', 2, 30, NULL), (4, 'a', NULL, 4611686018427387904, 0.5), (5, 'b', 1, -5, 4.0), (6, 'b', 1, NULL, NULL), (7, NULL, 3, NULL, 1.0), (8, 'a', 2, -4611686018427387904, 2.0)"
    calls = ("count(*)", "count(v)", "sum(v)", "avg(w)", "total(w)", "sum(w)", "count(v) FILTER (WHERE k <> 3)", "sum(v) FILTER (WHERE k IN (1, 3))", "min(v)")
    lite = sqlite3.connect(":memory:")
    for exclude in ("CURRENT ROW", "GROUP", "TIES", "NO OTHERS"):
        for by in ("PARTITION BY p ORDER BY o", "ORDER BY o", "PARTITION BY p"):
            over = f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {exclude})"
            part = [f"{c} {over}" for c in calls]
            sql = f"WITH t(k, p, o, v, w) AS (VALUES {values}) SELECT k, {', '.join(part)} FROM t ORDER BY k"
            assert [tuple(r) for r in rows(con, sql)] == lite.execute(sql).fetchall(), over


def test_columns_of_mixed_classes(con):
    con.execute_batch("CREATE TABLE u(a); INSERT INTO u VALUES (1), ('x'); INSERT INTO u VALUES (2.5), (NULL), (x'41'), (1.0), ('1')")
    assert rows(con, "SELECT a, typeof(a) FROM u ORDER BY rowid") == [(1, "integer"), ("x", "text"), (2.5, "real"), (None, "null"), (bytearray(b"A"), "blob"), (1.0, "real"), ("1", "text")]
    assert rows(con, "SELECT typeof(a), quote(a) FROM u ORDER BY a, rowid") == [("null", "NULL"), ("integer", "1"), ("real", "1.0"), ("real", "2.5"), ("text", "'1'"), ("text", "'x'"), ("blob", "X'41'")]
    assert rows(con, "SELECT count(*) FROM u WHERE a = 1") == [(2,)] and rows(con, "SELECT count(*) FROM u WHERE a > 2") == [(4,)] and rows(con, "SELECT count(*) FROM u WHERE a = '1'") == [(1,)]
    assert sorted(rows(con, "SELECT count(*) FROM u GROUP BY a")) == [(1,), (1,), (1,), (1,), (1,), (2,)]
    assert rows(con, "SELECT max(a), typeof(min(a)), sum(a), a || '!' FROM u WHERE typeof(a) <> 'blob' AND a < 2") == [(1, "integer", 2.0, "1!")]
    assert rows(con, "SELECT typeof(column1), length(column1) FROM (VALUES (1), ('xyz'), (2.5))") == [("integer", 1), ("text", 3), ("real", 3)]
    con.execute("UPDATE u SET a = 'new' WHERE typeof(a) = 'null'")
    assert rows(con, "SELECT count(*) FROM u WHERE a = 'new'") == [(1,)]


def test_strict_any_keeps_what_comes(con):
    con.execute("CREATE TABLE k(i INT, a ANY) STRICT")
    for v in (None, 12, 12.0, "0012", b"\x00\xff"):
        con.execute("INSERT INTO k VALUES (1, ?)", (v,))
    assert rows(con, "SELECT typeof(a), quote(a) FROM k ORDER BY rowid") == [("null", "NULL"), ("integer", "12"), ("real", "12.0"), ("text", "'0012'"), ("blob", "X'00FF'")]
    for bad in ((1.5, 1), ("abc", 1), (b"1", 1)):
        with pytest.raises(Exception):
            con.execute("INSERT INTO k VALUES (?, ?)", bad)
    assert rows(con, "SELECT count(*) FROM k") == [(5,)]


def test_upserts_against_the_embedded_database(con):
    import sqlite3

    m = sqlite3.connect(":memory:", isolation_level=None)
    script = [
        "CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT UNIQUE, n INT, b TEXT)", "INSERT INTO t VALUES (1,'x',1,'p'),(2,'y',2,'q'),(3,'z',3,'r')",
        "INSERT INTO t VALUES (9,'x',5,'s') ON CONFLICT(id) DO UPDATE SET n=100 ON CONFLICT(a) DO UPDATE SET n=200",
        "INSERT INTO t VALUES (2,'new',7,'u'),(4,'z',8,'v'),(5,'w',9,'w'),(5,'k',10,'m') ON CONFLICT(a) DO NOTHING ON CONFLICT(id) DO UPDATE SET b=b||excluded.b",
        "INSERT INTO t VALUES (2,'n2',7,'u'),(7,'z',8,'v') ON CONFLICT(a) DO UPDATE SET n=n+1000 ON CONFLICT DO NOTHING",
        "INSERT INTO t VALUES (1,'m',1,'a'),(1,'o',1,'b'),(8,'e',1,'c'),(8,'f',5,'d') ON CONFLICT(id) DO UPDATE SET n=n+excluded.n, b=b||excluded.b WHERE excluded.n < 5",
        "INSERT INTO t(a,n) VALUES ('e',1),('nn',5),('nn',6) ON CONFLICT(a) DO UPDATE SET n=excluded.n*10",
    ]
    for s in script:
        m.execute(s)
        con.execute(s)
        if not s.startswith("CREATE"):
            assert rows(con, "SELECT * FROM t ORDER BY id") == m.execute("SELECT * FROM t ORDER BY id").fetchall(), s


def test_numbers_beyond_64_bits(con):
    v = "(VALUES (9223372036854775807), (-9223372036854775808), (5), (NULL))"
    assert rows(con, f"SELECT typeof(column1 + 1), column1 + 1 > column1, CAST(-column1 AS REAL) FROM {v}") == [("real", 1, -9.223372036854775807e18), ("integer", 1, 9.223372036854775808e18), ("integer", 1, -5.0), ("null", None, None)]
    assert one(con, "SELECT 9223372036854775807 + 1, -9223372036854775808 / -1, - (-9223372036854775808)") == (9.223372036854775808e18,) * 3
    assert rows(con, f"SELECT count(*) FROM {v} a JOIN {v} b ON a.column1 + 1 = b.column1") == [(0,)]
    with pytest.raises(Exception):
        rows(con, f"SELECT column1 + 1 FROM {v}")


def test_far_limits_and_patterns(con):
    assert rows(con, "SELECT column1 FROM (VALUES (3), (1), (2)) ORDER BY 1 LIMIT 9223372036854775807 OFFSET 1") == [(2,), (3,)]
    assert rows(con, "SELECT column1 FROM (VALUES (3), (1), (2)) ORDER BY 1 LIMIT 2 OFFSET 3000000000") == []
    cases = [("z", "[z-a]", 1), ("b", "[z-a]", 0), ("a", "[a", 0), ("]", "[]]", 1), ("x", "[^]]", 1), (".", "[*]", 0), ("*", "[*]", 1), ("a-c", "a[-]c", 1), ("[", "[", 0), ("B1", "B*[]1", 0)]
    for x, p, want in cases:
        assert one(con, f"SELECT '{x}' GLOB '{p}'") == (want,), p
    assert rows(con, "SELECT column1 GLOB column2 FROM (VALUES " + ", ".join(f"('{x}', '{p}')" for x, p, _ in cases) + ")") == [(w,) for _, _, w in cases]


def test_errors_of_the_engine_are_errors_of_the_dialect(con):
    con.execute("CREATE TABLE t(a INT)")
    for bad in ("INSERT INTO t SELECT CAST('9223372036854775807' AS INT) + 1 FROM (VALUES (1)) v, (VALUES (2)) w", "INSERT INTO t VALUES (nothing)"):
        with pytest.raises(SqlError):
            con.execute(bad)
