"""A connection: registered tables, definitions, data changes as new table versions, transactions.

A table version is an immutable DataFrame written once; a change builds the next version,
checks it, and only then swaps the pointer. So a failed statement changes nothing, a transaction is a copy of
the pointers, and readers keep the version they started with.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.functions import scalar as S
from sedge.functions.scalar import E
from sedge.sources.scratch import written
from sedge.sql.lexer import SqlError
from sedge.sql.lower import Column, Field, Lowering, Scope
from sedge.sql.parser import N, Node, parse

_SPARK = {"int": "bigint", "real": "double", "text": "string", "blob": "binary", "null": "string", "ts": "timestamp", "cell": S.CELL}
STRICT_TYPES = {"INT": "int", "INTEGER": "int", "REAL": "real", "TEXT": "text", "BLOB": "blob", "ANY": "null"}
ROWID = "_rowid_"


#: Type names that are shown in capitals, however they were written.
STANDARD_TYPES = ("ANY", "BLOB", "INT", "INTEGER", "REAL", "TEXT")


class ConstraintError(SqlError):
    """A constraint does not hold."""


@dataclass
class TableColumn(Column):
    declared: str = ""
    notnull: str | None = None
    default: Node | None = None
    default_text: str | None = None
    generated: Node | None = None
    stored: bool = False
    pk: int = 0


@dataclass
class Key:
    """A unique key over columns or expressions, perhaps partial."""

    name: str
    terms: list[Node]
    policy: str
    where: Node | None = None
    origin: str = "c"
    unique: bool = True
    desc: tuple[bool, ...] = ()


@dataclass
class Table:
    name: str
    columns: list
    view: str
    df: DataFrame | None = None
    rowid: str | None = None
    keys: list[Key] = field(default_factory=list)
    checks: list = field(default_factory=list)
    strict: bool = False
    without_rowid: bool = False
    autoincrement: bool = False
    rowid_alias: str | None = None
    sequence: int = 0
    fixed: bool = False  # registered from outside: read only


@dataclass
class View:
    name: str
    query: Node
    columns: list[str] | None
    sql: str


@dataclass
class Result:
    columns: list[str]
    df: DataFrame | None
    changes: int = 0

    def rows(self) -> list[tuple]:
        plain = lambda v: v.toPython() if isinstance(v, T.VariantVal) else v
        return [tuple(map(plain, r)) for r in self.df.collect()] if self.df is not None else []


def spark_kind(t: T.DataType) -> tuple[str, bool]:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int", True
    if isinstance(t, T.LongType):
        return "int", False
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "real", False
    if isinstance(t, T.BooleanType):
        return "bool", False
    if isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return "ts", False
    if isinstance(t, T.BinaryType):
        return "blob", False
    return "text", False


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, View] = {}
        self.values = {"user_version": 0, "application_id": 0, "auto_vacuum": 0}
        self.offers: dict[str, object] = {}  # name: what registers the table when it is first named

    def table(self, name: str) -> Table | None:
        name = name.lower()
        if name not in self.tables and name in self.offers:
            self.offers[name]()
        return self.tables.get(name)

    def view(self, name: str) -> View | None:
        return self.views.get(name.lower())

    def snapshot(self):
        return {k: copy.copy(v) for k, v in self.tables.items()}, dict(self.views), dict(self.values)

    def restore(self, held) -> None:
        self.tables, self.views, self.values = {k: copy.copy(v) for k, v in held[0].items()}, dict(held[1]), dict(held[2])


class Connection:
    """execute, execute_batch, prepare and execute_prepared over one Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog(spark)
        self.state = {"changes": 0, "total_changes": 0, "last_insert_rowid": 0}
        self.saves: list[tuple[str | None, object]] = []  # (savepoint or None for BEGIN, snapshot)
        self.sink = None  # is called with the connection when changes are committed
        self.stored: dict[str, tuple] = {}  # the frame of a table and the version in a folder that holds it
        self._dirty = False

    # --- entry points ---

    def register(self, name: str, df: DataFrame, order: str | None = None) -> None:
        """A table from outside. order: a column that stands for the row order, where the dialect's results depend on it."""
        view = f"sedge_{name}_{Lowering.fresh(Lowering(self.catalog), 'v')}"
        df.createOrReplaceTempView(view)
        columns = []
        for f in df.schema.fields:
            kind, narrow = spark_kind(f.dataType)
            columns.append(TableColumn(f.name, kind, {"int": "int", "real": "real", "text": "text"}.get(kind), None, narrow, declared=kind.upper()))
        self.catalog.tables[name.lower()] = Table(name, columns, view, df, order, fixed=True)

    def offer(self, name: str, load, order: str | None = None) -> None:
        """As register, but load() is only called when a statement first names the table."""
        self.catalog.offers[name.lower()] = lambda: self.register(name, load(), order)

    def prepare(self, sql: str) -> Node:
        found = parse(sql)
        if len(found) != 1:
            raise SqlError("exactly one statement is expected")
        return found[0]

    def execute(self, sql: str, params=None) -> Result:
        return self.execute_prepared(self.prepare(sql), params)

    def sql(self, sql: str, params=None) -> DataFrame:
        return self.execute(sql, params).df

    def execute_batch(self, sql: str) -> list[Result]:
        return [self.execute_prepared(s) for s in parse(sql)]

    def execute_prepared(self, s: Node, params=None) -> Result:
        bound: dict[int, object] = {}
        if isinstance(params, dict):
            for k, v in params.items():
                at = s.params.get(k) or next((s.params[p + k] for p in ":@$" if p + k in s.params), None)
                if at is None:
                    raise SqlError(f"no such parameter: {k}")
                bound[at] = v
        else:
            bound = dict(enumerate(params or (), 1))
            if len(bound) > s.highest:
                raise SqlError("too many parameters")
        if s.kind in ("begin", "commit", "rollback", "savepoint", "release", "rollback_to"):
            result = getattr(self, f"s_{s.kind}")(s)
            self._dirty = self._dirty and s.kind != "rollback"
            self._kept_in_sink()
            return result
        held = self.catalog.snapshot()
        try:
            result = getattr(self, f"s_{s.kind}")(s, self.lowering(bound))
        except Exception as e:
            kept = getattr(s, "policy", None) == "fail" and getattr(s, "_kept", False)
            if kept:
                self._dirty = True
                self._kept_in_sink()
            else:
                self.catalog.restore(held)
            if getattr(s, "policy", None) == "rollback" and self.saves:
                self.catalog.restore(self.saves[0][1])
                self.saves.clear()
                self._dirty = False
            if isinstance(e, PySparkException):  # what a statement's own jobs or the analysis of its text meet
                raise SqlError(str(e).split("\n")[0]) from e
            raise
        if s.kind not in ("query", "explain") and (s.kind != "pragma" or s.arg is not None):
            self._dirty = True
            self._kept_in_sink()
        return result

    def _kept_in_sink(self) -> None:
        """Hands committed changes on, as soon as no transaction is open."""
        if self._dirty and not self.saves and self.sink is not None:
            self.sink(self)
            self._dirty = False

    def lowering(self, params=None) -> Lowering:
        return Lowering(self.catalog, params, self.state)

    # --- transactions ---

    def s_begin(self, s):
        if self.saves:
            raise SqlError("cannot start a transaction within a transaction")
        self.saves.append((None, self.catalog.snapshot()))
        return Result([], None)

    def s_commit(self, s):
        if not self.saves:
            raise SqlError("cannot commit - no transaction is active")
        self.saves.clear()
        return Result([], None)

    def s_rollback(self, s):
        if not self.saves:
            raise SqlError("cannot rollback - no transaction is active")
        self.catalog.restore(self.saves[0][1])
        self.saves.clear()
        return Result([], None)

    def s_savepoint(self, s):
        if len(self.saves) >= 16:
            raise SqlError("too many savepoints")
        self.saves.append((s.name.lower(), self.catalog.snapshot()))
        return Result([], None)

    def _save(self, name: str) -> int:
        for i in range(len(self.saves) - 1, -1, -1):
            if self.saves[i][0] == name.lower():
                return i
        raise SqlError(f"no such savepoint: {name}")

    def s_release(self, s):
        del self.saves[self._save(s.name) :]
        return Result([], None)

    def s_rollback_to(self, s):
        i = self._save(s.name)
        self.catalog.restore(self.saves[i][1])
        del self.saves[i + 1 :]
        return Result([], None)

    # --- queries ---

    def s_query(self, s, low):
        sql, columns = low.statement(s.query, True)
        return Result([c.label for c in columns], self.spark.sql(sql))

    def s_explain(self, s, low):
        if s.of.kind != "query":
            raise SqlError("only queries are explained")
        sql, _ = low.statement(s.of.query)
        return Result(["plan"], self.spark.sql(f"EXPLAIN FORMATTED {sql}"))

    # --- definitions ---

    def _new_name(self, name: str, quiet: bool) -> bool:
        if self.catalog.table(name) is not None or name.lower() in self.catalog.views:
            if quiet:
                return False
            raise SqlError(f"there is already an object named {name}")
        return True

    def _store(self, table: Table, df: DataFrame | None) -> None:
        """The next version of a table."""
        fields = [T.StructField(c.label, _type(c.ty)) for c in table.columns] + [T.StructField(ROWID, T.LongType())]
        if df is None:
            df = self.spark.createDataFrame([], T.StructType(fields))
        else:
            df = written(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]), f"table-{table.name}")
        new = copy.copy(table)
        new.df, new.view, new.rowid = df, f"sedge_{Lowering.fresh(Lowering(self.catalog), 't')}", ROWID
        df.createOrReplaceTempView(new.view)
        self.catalog.tables[table.name.lower()] = new

    def s_create_table(self, s, low):
        if not self._new_name(s.name, s.quiet):
            return Result([], None)
        columns, keys, checks = [], [], []
        t = Table(s.name, columns, "", strict=s.strict, without_rowid=s.without_rowid)
        primary = [c for c in s.constraints if c.kind == "primary"]
        for c in s.columns:
            if c.name.lower() in {x.label.lower() for x in columns}:
                raise SqlError(f"duplicate column name: {c.name}")
            aff = S.affinity(c.type)
            if s.strict:
                if c.type.upper() not in STRICT_TYPES:
                    raise SqlError(f"unknown datatype for {s.name}.{c.name}: {c.type!r}")
                ty = STRICT_TYPES[c.type.upper()]
                aff = "blob" if c.type.upper() == "ANY" else aff  # keeps whatever comes
            else:
                ty = {"int": "int", "real": "real", "text": "text"}.get(aff, "null")
            S.collated("", c.collate)
            columns.append(TableColumn(c.name, ty, aff, c.collate, declared=c.type, notnull=c.notnull, default=c.default, default_text=c.default_text, generated=c.generated, stored=c.stored))
            checks += c.checks
            if c.primary:
                primary.append(N("primary", terms=[N("term", expr=N("name", table=None, name=c.name, quoted=False), desc=False, nulls=None)], policy=c.primary[0], label=None, column=c))
            if c.unique:
                keys.append(Key(f"sqlite_autoindex_{s.name}_{len(keys) + 1}", [N("name", table=None, name=c.name, quoted=False)], c.unique, origin="u"))
        if len(primary) > 1:
            raise SqlError(f'table "{s.name}" has more than one primary key')
        for p in primary:
            names = [x.expr.of.name if x.expr.kind == "collate" else x.expr.name for x in p.terms]
            for i, n in enumerate(names):
                c = next((c for c in columns if c.label.lower() == n.lower()), None)
                if c is None:
                    raise SqlError(f"no such column: {n}")
                c.pk = i + 1
                if s.without_rowid:
                    c.notnull = c.notnull or "abort"
            only = next((c for c in columns if c.pk), None)
            of = getattr(p, "column", None)
            alias = len(names) == 1 and only.declared.upper() == "INTEGER" and not s.without_rowid and not (of is not None and of.primary[1])
            if alias:
                t.rowid_alias = only.label
                t.autoincrement = bool(of is not None and of.autoincrement)
            elif of is not None and of.autoincrement:
                raise SqlError("AUTOINCREMENT is only allowed on an INTEGER PRIMARY KEY")
            keys.insert(0, Key(f"sqlite_autoindex_{s.name}_1", [x.expr for x in p.terms], p.policy, origin="pk", desc=tuple(bool(x.desc) for x in p.terms)))
        if s.without_rowid and not primary:
            raise SqlError(f"PRIMARY KEY missing on table {s.name}")
        for c in s.constraints:
            if c.kind == "unique":
                keys.append(Key(f"sqlite_autoindex_{s.name}_{len(keys) + 1}", [x.expr for x in c.terms], c.policy, origin="u", desc=tuple(bool(x.desc) for x in c.terms)))
            elif c.kind == "check":
                checks.append((c.label, c.expr))
        t.keys, t.checks = keys, checks
        self._generated_order(t)
        self._store(t, None)
        self._bind_checks(self.catalog.tables[s.name.lower()])
        return Result([], None)

    def _bind_checks(self, t: Table) -> None:
        scope = self._scope(t, "t")
        for _, e in t.checks:
            self.lowering().expr(e, scope)
        for k in t.keys:
            for x in k.terms:
                self.lowering().expr(x, scope)

    def _generated_order(self, t: Table) -> list:
        """Generated columns, each after those it reads."""
        todo = [c for c in t.columns if c.generated is not None]
        names = {c.label.lower() for c in todo}
        done: list = []
        while todo:
            ready = [c for c in todo if not (_names(c.generated) & (names - {d.label.lower() for d in done}))]
            if not ready:
                raise SqlError("generated column loop")
            done += ready
            todo = [c for c in todo if c not in ready]
        return done

    def s_create_as(self, s, low):
        if not self._new_name(s.name, s.quiet):
            return Result([], None)
        sql, columns = low.statement(s.query)
        df = self.spark.sql(sql)
        names = {"int": "INT", "real": "REAL", "text": "TEXT", "null": "", "blob": "", "ts": "TEXT"}
        cols = [TableColumn(c.label, c.ty, {"int": "int", "real": "real", "text": "text"}.get(c.ty, "blob"), None, declared=names[c.ty]) for c in columns]
        t = Table(s.name, cols, "")
        self._store(t, self._numbered(df, 0)[0])
        return Result([], None)

    def s_create_view(self, s, low):
        if not self._new_name(s.name, s.quiet):
            return Result([], None)
        self.catalog.views[s.name.lower()] = View(s.name, s.query, s.columns, s.sql)
        return Result([], None)

    def s_create_index(self, s, low):
        if any(k.name.lower() == s.name.lower() for t in self.catalog.tables.values() for k in t.keys):
            if s.quiet:
                return Result([], None)
            raise SqlError(f"index {s.name} already exists")
        t = self._table(s.table)
        k = Key(s.name, [x.expr for x in s.terms], "abort", s.where, "c", s.unique, tuple(bool(x.desc) for x in s.terms))
        new = replace(t, keys=[*t.keys, k])
        self._bind_checks(new)
        if s.unique and not self._duplicates(new, new.df, k).isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: index '{s.name}'")
        self.catalog.tables[t.name.lower()] = new
        return Result([], None)

    def s_drop(self, s, low):
        name = s.name.lower()
        if s.what == "index":
            for t in list(self.catalog.tables.values()):
                if any(k.name.lower() == name and k.origin == "c" for k in t.keys):
                    self.catalog.tables[t.name.lower()] = replace(t, keys=[k for k in t.keys if k.name.lower() != name])
                    return Result([], None)
        elif s.what == "table" and self.catalog.table(name) is not None:
            del self.catalog.tables[name]
            self.catalog.offers.pop(name, None)
            return Result([], None)
        elif s.what == "view" and name in self.catalog.views:
            del self.catalog.views[name]
            return Result([], None)
        if s.quiet:
            return Result([], None)
        raise SqlError(f"no such {s.what}: {s.name}")

    def _table(self, name: str, write: bool = True) -> Table:
        t = self.catalog.table(name)
        if t is None:
            raise SqlError(f"cannot modify {name} because it is a view" if name.lower() in self.catalog.views else f"no such table: {name}")
        if write and t.fixed:
            raise SqlError(f"table {name} is read only")
        return t

    def _column(self, t: Table, name: str):
        c = next((c for c in t.columns if c.label.lower() == name.lower()), None)
        if c is None:
            raise SqlError(f'no such column: "{name}"')
        return c

    def s_rename_table(self, s, low):
        t = self._table(s.table)
        self._new_name(s.to, False)
        del self.catalog.tables[t.name.lower()]
        self.catalog.tables[s.to.lower()] = replace(t, name=s.to)
        for k, v in self.catalog.views.items():
            q = copy.deepcopy(v.query)
            _rename(q, "table", t.name.lower(), s.to)
            self.catalog.views[k] = replace(v, query=q)
        return Result([], None)

    def s_rename_column(self, s, low):
        t = self._table(s.table)
        old = self._column(t, s.name)
        if any(c.label.lower() == s.to.lower() for c in t.columns):
            raise SqlError(f'duplicate column name: "{s.to}"')
        new = copy.deepcopy(replace(t, df=None))
        for c in new.columns:
            if c.label == old.label:
                c.label = s.to
            if c.generated is not None:
                _rename(c.generated, "name", old.label.lower(), s.to)
        for k in new.keys:
            _rename([k.terms, k.where], "name", old.label.lower(), s.to)
        _rename(new.checks, "name", old.label.lower(), s.to)
        if new.rowid_alias == old.label:
            new.rowid_alias = s.to
        self._store(new, t.df.withColumnRenamed(old.label, s.to))
        for k, v in self.catalog.views.items():
            if self.lowering().mentions(v.query, t.name.lower()):
                q = copy.deepcopy(v.query)
                _rename(q, "name", old.label.lower(), s.to)
                self.catalog.views[k] = replace(v, query=q)
        return Result([], None)

    def s_add_column(self, s, low):
        t, c = self._table(s.table), s.column
        if any(x.label.lower() == c.name.lower() for x in t.columns):
            raise SqlError(f"duplicate column name: {c.name}")
        if c.primary or c.unique:
            raise SqlError("Cannot add a PRIMARY KEY or UNIQUE column")
        if c.notnull and c.default is None and c.generated is None and not t.df.isEmpty():
            raise SqlError("Cannot add a NOT NULL column with default value NULL")
        aff = S.affinity(c.type)
        col = TableColumn(c.name, {"int": "int", "real": "real", "text": "text"}.get(aff, "null"), aff, c.collate, declared=c.type, notnull=c.notnull, default=c.default, default_text=c.default_text, generated=c.generated, stored=c.stored)
        new = replace(t, columns=[*t.columns, col], checks=[*t.checks, *c.checks])
        if c.generated is not None:
            e = self.lowering().expr(c.generated, self._scope(t, "t"))
        else:
            e = self.lowering().expr(c.default, Scope([])) if c.default is not None else S.literal(None)
        value, col.ty = self._assigned(col, e, new.strict)
        t.df.createOrReplaceTempView("sedge_alter")
        self._store(new, self.spark.sql(f"SELECT *, {value} AS `{c.name}` FROM sedge_alter t"))
        self._check(self.catalog.tables[t.name.lower()], self.catalog.tables[t.name.lower()].df, "abort", None)
        return Result([], None)

    def s_drop_column(self, s, low):
        t = self._table(s.table)
        c = self._column(t, s.name)
        if c.pk or any(c.label.lower() in _names(k.terms) | _names(k.where) for k in t.keys):
            raise SqlError(f'cannot drop PRIMARY KEY or UNIQUE column: "{c.label}"')
        if len(t.columns) == 1:
            raise SqlError(f'cannot drop column "{c.label}": no other columns exist')
        if any(c.label.lower() in _names(e) for _, e in t.checks) or any(x.generated is not None and c.label.lower() in _names(x.generated) for x in t.columns):
            raise SqlError(f'error in table {t.name} after drop column: no such column: {c.label}')
        self._store(replace(t, columns=[x for x in t.columns if x is not c]), t.df.drop(c.label))
        return Result([], None)

    def s_set_not_null(self, s, low):
        t = self._table(s.table)
        c = self._column(t, s.name)
        if s.on and not t.df.where(F.col(f"`{c.label}`").isNull()).isEmpty():
            raise ConstraintError("constraint failed")
        self.catalog.tables[t.name.lower()] = replace(t, columns=[replace(x, notnull="abort" if s.on else None) if x is c else x for x in t.columns])
        return Result([], None)

    def s_add_check(self, s, low):
        t = self._table(s.table)
        e = low.expr(s.expr, self._scope(t, "t"))
        t.df.createOrReplaceTempView("sedge_alter")
        if not self.spark.sql(f"SELECT 1 FROM sedge_alter t WHERE NOT coalesce({S.truth(e)}, false)").isEmpty():
            raise ConstraintError("constraint failed")
        self.catalog.tables[t.name.lower()] = replace(t, checks=[*t.checks, (s.label, s.expr)])
        return Result([], None)

    def s_drop_check(self, s, low):
        t = self._table(s.table)
        left = [c for c in t.checks if (c[0] or "").lower() != s.label.lower()]
        if len(left) == len(t.checks):
            raise SqlError(f"no such constraint: {s.label}")
        self.catalog.tables[t.name.lower()] = replace(t, checks=left)
        return Result([], None)

    # --- changes ---

    def _scope(self, t: Table, alias: str, quals=None) -> Scope:
        q = frozenset(quals or [t.name.lower(), alias])
        fields = [Field(c.label, E(f"{alias}.`{c.label}`", c.ty, c.aff, c.coll, narrow=c.narrow), q) for c in t.columns]
        return Scope([*fields, Field(ROWID, E(f"{alias}.`{ROWID}`", "int", "int"), q, hidden=True)])

    def _assigned(self, c, e: E, strict: bool) -> tuple[str, str]:
        """A value as the column stores it, and the column's type, which an untyped column takes from what it gets."""
        if e.items:
            raise SqlError("row value misused")
        ty = "int" if e.ty == "bool" else e.ty
        want = c.ty
        if c.aff == "numeric" and ty == "text":
            n = S.whole_number(e)
            return f"CASE WHEN {e.sql} IS NULL THEN NULL ELSE coalesce({n}, raise_error('datatype mismatch')) END", "real" if want in ("null", "real") else S.common([E("", want), E("", "real")])
        if want == "cell":
            return S.cell(e), "cell"
        if want == "null":
            return S.out(e), ty
        if ty == "null":
            return f"CAST(NULL AS {_SPARK[want]})", want
        if ty == want:
            return S.out(e), want
        bad = f"raise_error('cannot store {ty.upper()} value in {want.upper()} column {c.label}')"
        if c.aff == "blob" and (not strict or c.declared.upper() == "ANY"):
            return S.cell(e), "cell"  # an untyped column that has seen several classes
        if want in ("int", "real") and ty in ("int", "real"):
            if want == "real":
                return S.real(replace(e, ty=ty, sql=S.out(e))), want
            if c.aff == "int" or strict:
                return f"CASE WHEN {e.sql} IS NULL THEN NULL WHEN {e.sql} = floor({e.sql}) AND abs({e.sql}) < 9.2e18D THEN CAST({e.sql} AS BIGINT) ELSE {bad} END", want
            return S.real(e), "real"
        if want in ("int", "real") and ty == "text":
            n = S.whole_number(e)
            v = n if want == "real" else f"CASE WHEN {n} = floor({n}) THEN coalesce(try_cast(trim({e.sql}) AS BIGINT), CAST({n} AS BIGINT)) END"
            return f"CASE WHEN {e.sql} IS NULL THEN NULL ELSE coalesce({v}, {bad}) END", want
        if want == "text" and ty in ("int", "real", "ts"):
            if strict and ty != "ts":
                return S.text(e), want
            return S.text(e), want
        return f"CASE WHEN {e.sql} IS NULL THEN NULL ELSE {bad} END", want

    def _numbered(self, df: DataFrame, start: int, column: str = ROWID) -> tuple[DataFrame, int]:
        """df written with row numbers from start + 1 in its order, counted by partition; and the number of its rows."""
        staged = written(df.withColumn("_m", F.monotonically_increasing_id()), "batch").withColumn("_p", F.shiftright("_m", 33))
        counts = staged.groupBy("_p").agg(F.count("*").alias("_n")).orderBy("_p").collect()  # a row for each partition
        total, before = 0, []
        for r in counts:
            before.append((r["_p"], total))
            total += r["_n"]
        ahead = F.broadcast(self.spark.createDataFrame(before, "_p long, _before long"))
        place = (F.lit(start + 1) + F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
        names = [c for c in staged.columns if c not in ("_m", "_p")]
        return staged.join(ahead, "_p").select(*[F.col(f"`{n}`") for n in names if n != column], place.alias(column)), total

    def s_insert(self, s, low):
        t = self._table(s.table)
        names = s.columns or [c.label for c in t.columns if c.generated is None]
        targets = [self._column(t, n) if n.lower() not in ("rowid", "oid", ROWID) or any(c.label.lower() == n.lower() for c in t.columns) else None for n in names]
        if any(c is not None and c.generated is not None for c in targets):
            raise SqlError("cannot INSERT into generated column")
        query = s.source
        if s.ctes and query is not None:
            query = copy.copy(query)
            query.ctes = s.ctes if query.ctes is None else query.ctes
        if query is None:
            source, columns = self.spark.sql("SELECT 1 AS c0"), []
            names, targets = [], []
        else:
            sql, columns = low.statement(query)
            source = self.spark.sql(sql).toDF(*[f"c{i}" for i in range(len(columns))])
            if len(columns) != len(names):
                raise SqlError(f"table {t.name} has {len(names)} columns but {len(columns)} values were supplied")
        start = self._high(t)
        batch, n = self._numbered(source, 0, "_ord")
        batch.createOrReplaceTempView("sedge_batch")
        given = {}
        for i, (c, col) in enumerate(zip(targets, columns)):
            given[c.label if c is not None else ROWID] = E(f"b.c{i}", col.ty, col.aff, col.coll, narrow=col.narrow)
        cells, types = [], {}
        for c in t.columns:
            if c.generated is not None:
                continue
            e = given.get(c.label)
            if e is None:
                e = low.expr(c.default, Scope([])) if c.default is not None else S.literal(None)
            value, types[c.label] = self._assigned(c, e, t.strict)
            if t.rowid_alias == c.label:
                value = f"coalesce({value}, b._ord + {start}L)" if c.label in given else f"b._ord + {start}L"
            elif c.notnull and c.default is not None and (s.policy or c.notnull) == "replace":
                value = f"coalesce({value}, {self._assigned(c, low.expr(c.default, Scope([])), t.strict)[0]})"
            cells.append(f"{value} AS `{c.label}`")
        rid = f"coalesce({S.integer(given[ROWID])}, b._ord + {start}L)" if ROWID in given else f"b._ord + {start}L"
        df = self.spark.sql(f"SELECT {', '.join(cells)}, {rid} AS `{ROWID}`, b._ord FROM sedge_batch b")
        if t.rowid_alias:
            df = df.withColumn(ROWID, F.col(f"`{t.rowid_alias}`"))
        t = self._retyped(t, types)
        df = written(self._generate(t, df), "insert")
        if s.upserts:
            return self._upsert(s, t, df, start if ROWID not in given and (t.rowid_alias is None or t.rowid_alias not in given) else None)
        old, new = self._settle(s, t, t.df, df, s.policy, None)
        if "ignore" in {s.policy, *(k.policy for k in t.keys)} and ROWID not in given and (t.rowid_alias is None or t.rowid_alias not in given):
            new = self._closed_up(t, new, start)
        return self._changed(s, t, old, new, n_last=True)

    def _closed_up(self, t: Table, new: DataFrame, start: int) -> DataFrame:
        """Row numbers without the gaps that ignored rows left."""
        out = self._numbered(new.drop(ROWID).orderBy("_ord"), start)[0]
        return self._generate(t, out.withColumn(t.rowid_alias, F.col(ROWID))) if t.rowid_alias else out

    def _high(self, t: Table) -> int:
        top = t.df.agg(F.max(ROWID)).first()[0] or 0
        return max(top, t.sequence if t.autoincrement else 0)

    def _retyped(self, t: Table, types: dict[str, str]) -> Table:
        """Columns that got their first type, or a wider one, with the stored rows recast."""
        changed = {c.label: types[c.label] for c in t.columns if types.get(c.label) not in (None, "null", c.ty)}
        if not changed:
            return t
        columns = [replace(c, ty=changed[c.label]) if c.label in changed else c for c in t.columns]
        df = t.df
        for n, ty in changed.items():
            was = next(c.ty for c in t.columns if c.label == n)
            df = df.withColumn(n, F.expr(S.cell(E(f"`{n}`", was))) if ty == "cell" else F.col(f"`{n}`").cast(_SPARK[ty]))
        return replace(t, columns=columns, df=df)

    def _generate(self, t: Table, df: DataFrame) -> DataFrame:
        for c in self._generated_order(t):
            df.createOrReplaceTempView("sedge_generate")
            known = replace(t, columns=[x for x in t.columns if x.label in df.columns])
            e = self.lowering().expr(c.generated, self._scope(known, "g"))
            value, ty = self._assigned(c, e, t.strict)
            c.ty = ty if c.ty == "null" else c.ty
            names = [f"g.`{x}`" for x in df.columns if x != c.label]
            df = self.spark.sql(f"SELECT {', '.join(names)}, {value} AS `{c.label}` FROM sedge_generate g")
        return df

    def _key_sql(self, t: Table, k: Key, alias: str) -> tuple[list[str], str]:
        scope = self._scope(t, alias)
        low = self.lowering()
        keys = [S.key(e) if e.ty != "bool" else S.out(e) for e in (low.expr(x, scope) for x in k.terms)]
        where = " AND ".join([f"{x} IS NOT NULL" for x in keys] + ([S.truth(low.expr(k.where, scope))] if k.where is not None else []))
        return keys, where

    def _duplicates(self, t: Table, df: DataFrame, k: Key) -> DataFrame:
        df.createOrReplaceTempView("sedge_unique")
        keys, where = self._key_sql(t, k, "u")
        return self.spark.sql(f"SELECT count(*) FROM sedge_unique u WHERE {where} GROUP BY {', '.join(keys)} HAVING count(*) > 1")

    def _check(self, t: Table, df: DataFrame, policy: str | None, s) -> DataFrame:
        """Rows that hold NOT NULL and CHECK; IGNORE leaves the others out, FAIL those from the first on, the rest is an error."""
        scope, low = self._scope(t, "k"), self.lowering()
        rules = [(f"k.`{c.label}` IS NULL", policy or c.notnull, f"NOT NULL constraint failed: {t.name}.{c.label}") for c in t.columns if c.notnull and not (c.label == t.rowid_alias)]
        rules += [(f"NOT coalesce({S.truth(low.expr(e, scope))}, true)", policy or "abort", f"CHECK constraint failed: {label or t.name}") for label, e in t.checks]
        if rules and all(how not in ("ignore", "fail") for _, how, _ in rules):
            # One pass for all; only where a row breaks any is it asked which.
            df.createOrReplaceTempView("sedge_check")
            if self.spark.sql("SELECT 1 FROM sedge_check k WHERE " + " OR ".join(f"({cond})" for cond, _, _ in rules)).isEmpty():
                return df
        for cond, how, message in rules:
            df.createOrReplaceTempView("sedge_check")
            if how == "ignore":
                df = self.spark.sql(f"SELECT k.* FROM sedge_check k WHERE NOT ({cond})")
            else:
                bad = self.spark.sql(f"SELECT * FROM sedge_check k WHERE {cond}")
                self._refuse(s, t, df, bad, how, message)
        return df

    def _refuse(self, s, t: Table, df: DataFrame, bad: DataFrame, how: str, message: str) -> None:
        if how == "fail" and s is not None and "_ord" in df.columns:
            first = bad.agg(F.min("_ord")).first()[0]
            if first is None:
                return
            if s.kind == "insert":
                kept = written(df.where(F.col("_ord") < first), "fail")
                self._store(t, t.df.unionByName(kept.drop("_ord")))
                s._kept, s.policy = True, "fail"
        elif bad.isEmpty():
            return
        if s is not None and how == "rollback":
            s.policy = "rollback"
        raise ConstraintError(message)

    def _settle(self, s, t: Table, old: DataFrame, new: DataFrame, policy: str | None, moved: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Old rows that stay and new rows that come, after all constraints. moved: identifiers of old rows that the new ones replace."""
        new = self._check(t, new, policy, s)
        keys = list(t.keys)
        if t.rowid_alias is None and not t.without_rowid:
            keys = [Key("rowid", [N("name", table=None, name=ROWID, quoted=False)], "abort"), *keys]
        later: list[tuple[DataFrame, str, str]] = []
        for k in [k for k in keys if k.unique]:
            how = policy or k.policy
            a, where_a = self._key_sql(t, k, "a")
            b, where_b = self._key_sql(t, k, "b")
            new.createOrReplaceTempView("sedge_new")
            old.createOrReplaceTempView("sedge_old")
            on = " AND ".join(f"{x} = {y}" for x, y in zip(a, b))
            if how == "replace":
                new = self.spark.sql(f"SELECT * EXCEPT (_n) FROM (SELECT a.*, CASE WHEN {where_a} THEN row_number() OVER (PARTITION BY {', '.join(a)} ORDER BY a._ord DESC) ELSE 1 END AS _n FROM sedge_new a) WHERE _n = 1")
                old = self.spark.sql(f"SELECT b.* FROM sedge_old b LEFT ANTI JOIN (SELECT * FROM sedge_new a WHERE {where_a}) a ON {where_b} AND {on}")
                continue
            clash = f"SELECT a.* FROM sedge_new a LEFT SEMI JOIN (SELECT * FROM sedge_old b WHERE {where_b}) b ON {where_a} AND {on}"
            if how == "ignore":
                new = self.spark.sql(f"SELECT a.* FROM sedge_new a LEFT ANTI JOIN (SELECT * FROM sedge_old b WHERE {where_b}) b ON {where_a} AND {on}")
                new.createOrReplaceTempView("sedge_new")
                new = self.spark.sql(f"SELECT * EXCEPT (_n) FROM (SELECT a.*, CASE WHEN {where_a} THEN row_number() OVER (PARTITION BY {', '.join(a)} ORDER BY a._ord) ELSE 1 END AS _n FROM sedge_new a) WHERE _n = 1")
                continue
            twice = f"SELECT * EXCEPT (_n) FROM (SELECT a.*, row_number() OVER (PARTITION BY {', '.join(a)} ORDER BY a._ord) AS _n FROM sedge_new a WHERE {where_a}) WHERE _n > 1"
            bad = self.spark.sql(f"{clash} UNION ALL {twice}")
            message = f"UNIQUE constraint failed: {k.name if k.origin == 'c' else ', '.join(f'{t.name}.{n}' for n in sorted(_names(k.terms)))}"
            if how == "fail":
                self._refuse(s, t, new, bad, how, message)
            else:
                later.append((bad, how, message))
        # One pass for all keys; only where one is broken is it asked which.
        if len(later) > 1:
            some = later[0][0].select("_ord")
            for bad, _, _ in later[1:]:
                some = some.unionAll(bad.select("_ord"))
            later = [] if some.isEmpty() else later
        for bad, how, message in later:
            self._refuse(s, t, new, bad, how, message)
        return old, new

    def _changed(self, s, t: Table, old: DataFrame, new: DataFrame, n_last: bool = False) -> Result:
        if getattr(new, "scratch_path", None) is None:
            new = written(new, "changed")
        n = new.count()
        if n_last and n:
            self.state["last_insert_rowid"] = new.orderBy(F.desc("_ord")).select(ROWID).first()[0]
        result = self._returning(s, t, new)
        self._store(t, old.unionByName(new.drop("_ord")))
        stored = self.catalog.tables[t.name.lower()]
        if t.autoincrement and n:
            stored.sequence = max(t.sequence, new.agg(F.max(ROWID)).first()[0])
        self.state["changes"], self.state["total_changes"] = n, self.state["total_changes"] + n
        result.changes = n
        return result

    def _returning(self, s, t: Table, rows: DataFrame) -> Result:
        if not s.returning:
            return Result([], None)
        name = f"sedge_returning_{Lowering.fresh(Lowering(self.catalog), 'r')}"
        rows.createOrReplaceTempView(name)
        low = self.lowering()
        scope = self._scope(t, "o", [t.name.lower(), (s.alias or t.name).lower()])
        cols = []
        for c in s.returning:
            cols += low.star(c, scope) if c.kind == "star" else [c]
        bound = [low.expr(c.expr, scope) for c in cols]
        labels = [c.alias or low.label(c, scope) for c in cols]
        cells = ", ".join(f"{S.shown(e.sql) if e.ty == 'cell' else S.out(e)} AS `{n}`" for e, n in zip(bound, labels))
        by = " ORDER BY o._ord" if "_ord" in rows.columns else ""
        return Result(labels, self.spark.sql(f"SELECT {cells} FROM {name} o{by}"))

    def s_update(self, s, low):
        t = self._table(s.table)
        quals = [(s.alias or t.name).lower()]
        if s.ctes:
            for c in s.ctes.ctes:
                low.ctes[-1][c.name.lower()] = N("cte_state", cte=c, scope=list(low.ctes), rel=None, busy=False, outer=None)
        scope = self._scope(t, "o", quals)
        t.df.createOrReplaceTempView("sedge_update")
        where = low.condition(s.where, scope) if s.where is not None else "true"
        sets, types = self._sets(s.sets, t, low, scope)
        head = f"WITH {', '.join(low.heads)} " if low.heads else ""
        cells = [f"{sets.get(c.label, f'o.`{c.label}`')} AS `{c.label}`" for c in t.columns if c.generated is None]
        rid = sets.get(t.rowid_alias) if t.rowid_alias in sets else sets.get(ROWID, f"o.`{ROWID}`")
        new = self.spark.sql(f"{head}SELECT {', '.join(cells)}, {rid} AS `{ROWID}`, o.`{ROWID}` AS _ord FROM sedge_update o WHERE {where}")
        t2 = self._retyped(t, types)
        new = written(self._generate(t2, new), "update")
        old = t2.df.join(new.select(F.col("_ord").alias("_gone")), F.col(ROWID) == F.col("_gone"), "left_anti")
        kept_old, kept = self._settle(s, t2, old, new, s.policy, None)
        if (s.policy or "") == "ignore" or any(k.policy == "ignore" for k in t2.keys):
            lost = new.join(kept.select(F.col("_ord").alias("_k")), F.col("_ord") == F.col("_k"), "left_anti").select(F.col("_ord").alias("_l"))
            kept_old = kept_old.unionByName(t2.df.join(lost, F.col(ROWID) == F.col("_l"), "left_semi"))
        return self._changed(s, t2, kept_old, kept)

    def _sets(self, assignments, t: Table, low, scope) -> tuple[dict[str, str], dict[str, str]]:
        sets, types = {}, {}
        for names, e in assignments:
            values = low.expr(e, scope)
            parts = list(values.items) if len(names) > 1 else [values]
            if len(parts) != len(names):
                raise SqlError(f"{len(names)} columns assigned {len(parts)} values")
            for n, v in zip(names, parts):
                if n.lower() in ("rowid", "oid", ROWID) and not any(c.label.lower() == n.lower() for c in t.columns):
                    sets[ROWID] = S.integer(v)
                    continue
                c = self._column(t, n)
                if c.generated is not None:
                    raise SqlError(f'cannot UPDATE generated column "{c.label}"')
                sets[c.label], types[c.label] = self._assigned(c, v, t.strict)
        return sets, types

    def s_delete(self, s, low):
        t = self._table(s.table)
        if s.ctes:
            for c in s.ctes.ctes:
                low.ctes[-1][c.name.lower()] = N("cte_state", cte=c, scope=list(low.ctes), rel=None, busy=False, outer=None)
        scope = self._scope(t, "o", [(s.alias or t.name).lower()])
        t.df.createOrReplaceTempView("sedge_delete")
        where = low.condition(s.where, scope) if s.where is not None else "true"
        head = f"WITH {', '.join(low.heads)} " if low.heads else ""
        gone = written(self.spark.sql(f"{head}SELECT o.* FROM sedge_delete o WHERE {where}"), "deleted")
        n = gone.count()
        result = self._returning(s, t, gone)
        self._store(t, t.df.join(gone.select(F.col(ROWID).alias("_gone")), F.col(ROWID) == F.col("_gone"), "left_anti"))
        self.state["changes"], self.state["total_changes"] = n, self.state["total_changes"] + n
        result.changes = n
        return result

    # --- upsert ---

    def _upsert(self, s, t: Table, batch: DataFrame, start: int | None) -> Result:
        """Clauses in their order, each for one unique key; one without a target stands for all keys that are left.
        start: the highest row number before, where new rows get the next ones."""
        low = self.lowering()
        scope = self._scope(t, "x")
        keys = [k for k in t.keys if k.unique]
        clauses: list[tuple[Key, object]] = []
        for u in s.upserts:
            if u.target is None:
                if u is not s.upserts[-1]:
                    raise SqlError("only the last ON CONFLICT clause may have no target")
                clauses += [(k, u) for k in keys if all(k is not c for c, _ in clauses)]
                continue
            want = sorted(low.expr(x.expr, scope).sql for x in u.target)
            key = next((k for k in keys if sorted(low.expr(e, scope).sql for e in k.terms) == want), None)
            if key is None:
                raise SqlError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
            if all(key is not c for c, _ in clauses):
                clauses.append((key, u))
        if len(s.upserts) == 1 and s.upserts[0].target is None and s.upserts[0].sets is None:
            old, new = self._settle(s, t, t.df, batch, "ignore", None)
            return self._changed(s, t, old, self._closed_up(t, new, start) if start is not None else new, n_last=True)
        if len(clauses) == 1 and not any(c.generated is not None for c in t.columns) and not _has_query(s.upserts):
            new = self._folded(s, t, batch, *clauses[0])
        else:
            new = self._in_rounds(s, t, batch, clauses)
        if start is not None:
            came = self._closed_up(t, new.where("_was IS NULL").drop("_was"), start).withColumn("_was", F.lit(None).cast("long"))
            new = new.where("_was IS NOT NULL").unionByName(came)
        old = t.df.join(new.select(F.col("_was").alias("_gone")).where("_gone IS NOT NULL"), F.col(ROWID) == F.col("_gone"), "left_anti")
        old, new = self._settle(s, t, old, new.drop("_was"), s.policy, None)
        return self._changed(s, t, old, new, n_last=True)

    def _both(self, s, t: Table) -> Scope:
        """The stored row as b, the one that came as a, which is also `excluded`."""
        own = self._scope(t, "b", [t.name.lower(), (s.alias or t.name).lower()]).fields
        return Scope([*own, *[replace(f, quals=frozenset(["excluded"]), merged=True) for f in self._scope(t, "a").fields if not f.hidden]])

    def _folded(self, s, t: Table, batch: DataFrame, key: Key, u) -> DataFrame:
        """The rows that change, with the identifier of the stored row they take the place of in _was: the rows of a key are
        folded in their order over the stored one, in one pass."""
        low = self.lowering()
        a, where_a = self._key_sql(t, key, "a")
        b, where_b = self._key_sql(t, key, "b")
        batch.createOrReplaceTempView("sedge_new")
        t.df.createOrReplaceTempView("sedge_old")
        names = [*[c.label for c in t.columns], ROWID]
        kinds = {f.name: f.dataType.simpleString() for f in batch.schema.fields}

        def row(cells: dict[str, str], ord_: str, was: str) -> str:
            inner = ", ".join(f"'{n}', CAST({cells[n]} AS {kinds[n]})" for n in names)
            return f"named_struct('_ord', CAST({ord_} AS BIGINT), {inner}, '_was', CAST({was} AS BIGINT))"

        each = row({n: f"a.`{n}`" for n in names}, "a._ord", "NULL")
        same = " AND ".join(f"g.k{i} = {y}" for i, y in enumerate(b))
        groups = f"SELECT {', '.join(f'{x} AS k{i}' for i, x in enumerate(a))}, array_sort(collect_list({each}), (l, r) -> CASE WHEN l._ord < r._ord THEN -1 WHEN l._ord > r._ord THEN 1 ELSE 0 END) AS items FROM sedge_new a WHERE {where_a} GROUP BY {', '.join(a)}"
        first = f"CASE WHEN b.`{ROWID}` IS NULL THEN g.items[0] ELSE {row({n: f'b.`{n}`' for n in names}, 'NULL', f'b.`{ROWID}`')} END"
        if u.sets is None:
            folded = first
        else:
            both = self._both(s, t)
            sets, _ = self._sets(u.sets, t, low, both)
            when = S.truth(low.expr(u.when, both)) if u.when is not None else "true"
            cells = {n: sets.get(n, f"b.`{n}`") for n in names}
            cells[ROWID] = sets.get(t.rowid_alias, cells[ROWID]) if t.rowid_alias else cells[ROWID]
            step = f"CASE WHEN coalesce({when}, false) THEN {row(cells, 'a._ord', 'b._was')} ELSE b END"
            rest = f"CASE WHEN b.`{ROWID}` IS NULL THEN slice(g.items, 2, greatest(size(g.items) - 1, 1)) ELSE g.items END"
            folded = f"aggregate({rest}, {first}, (b, a) -> {step})"
        alone = f"SELECT {each} AS r FROM sedge_new a WHERE NOT coalesce({where_a}, false)"
        sql = f"SELECT r.* FROM (SELECT {folded} AS r FROM ({groups}) g LEFT JOIN (SELECT * FROM sedge_old b WHERE {where_b}) b ON {same} UNION ALL {alone}) WHERE r._ord IS NOT NULL"
        return written(self.spark.sql(sql), "upsert")

    def _in_rounds(self, s, t: Table, batch: DataFrame, clauses: list) -> DataFrame:
        """As _folded, for several keys: rounds of the rows that come first under each of their keys, over the stored rows that any
        of them meets."""
        low = self.lowering()
        sql = {}
        for k, _ in clauses:
            sql[id(k)] = (*self._key_sql(t, k, "a"), *self._key_sql(t, k, "b"))
        batch.createOrReplaceTempView("sedge_new")
        t.df.createOrReplaceTempView("sedge_old")

        def on(k: Key) -> str:
            a, where_a, b, where_b = sql[id(k)]
            return f"{where_a} AND {where_b} AND " + " AND ".join(f"{x} = {y}" for x, y in zip(a, b))

        met = " UNION ".join(f"SELECT b.`{ROWID}` AS _id FROM sedge_old b LEFT SEMI JOIN sedge_new a ON {on(k)}" for k, _ in clauses)
        state = written(self.spark.sql(f"SELECT b.*, CAST(NULL AS BIGINT) AS _ord, b.`{ROWID}` AS _was FROM sedge_old b LEFT SEMI JOIN ({met}) m ON b.`{ROWID}` = m._id"), "upsert")
        names = state.columns
        left = batch.withColumn("_was", F.lit(None).cast("long"))
        while not left.isEmpty():
            left.createOrReplaceTempView("sedge_left")
            places = ", ".join(f"CASE WHEN {sql[id(k)][1]} THEN row_number() OVER (PARTITION BY {', '.join(sql[id(k)][0])} ORDER BY a._ord) ELSE 1 END AS _n{i}" for i, (k, _) in enumerate(clauses))
            ranked = written(self.spark.sql(f"SELECT a.*, {places} FROM sedge_left a"), "upsert")
            first = " AND ".join(f"_n{i} = 1" for i in range(len(clauses)))
            now = ranked.where(first).select(*names)
            left = ranked.where(f"NOT ({first})").select(*names)
            for k, u in clauses:
                now.createOrReplaceTempView("sedge_now")
                state.createOrReplaceTempView("sedge_state")
                rest = written(self.spark.sql(f"SELECT a.* FROM sedge_now a LEFT ANTI JOIN sedge_state b ON {on(k)}"), "upsert")
                if u.sets is not None:
                    both = self._both(s, t)
                    sets, _ = self._sets(u.sets, t, low, both)
                    when = S.truth(low.expr(u.when, both)) if u.when is not None else "true"
                    hit = f"a._ord IS NOT NULL AND coalesce({when}, false)"
                    cells = [f"CASE WHEN {hit} THEN {sets[c.label]} ELSE b.`{c.label}` END AS `{c.label}`" if c.label in sets else f"b.`{c.label}`" for c in t.columns if c.generated is None]
                    rid = f"CASE WHEN {hit} THEN {sets[t.rowid_alias]} ELSE b.`{ROWID}` END" if t.rowid_alias in sets else f"b.`{ROWID}`"
                    updated = self.spark.sql(f"SELECT {', '.join(cells)}, {rid} AS `{ROWID}`, CASE WHEN {hit} THEN a._ord ELSE b._ord END AS _ord, b._was FROM sedge_state b LEFT JOIN sedge_now a ON {on(k)}")
                    state = written(self._generate(t, updated).select(*names), "upsert")
                now = rest
            state = written(state.unionByName(now), "upsert")
        return state.where("_ord IS NOT NULL")

    # --- pragmas ---

    def s_pragma(self, s, low):
        make = lambda rows, ddl: Result([x.split()[0] for x in ddl.split(", ")], self.spark.createDataFrame(rows, ddl))
        if s.name in ("user_version", "application_id"):
            if s.arg is not None:
                self.catalog.values[s.name] = int(s.arg)
                return Result([], None)
            return make([(self.catalog.values[s.name],)], f"{s.name} long")
        if s.name == "auto_vacuum" and s.arg is None:
            return make([(0,)], "auto_vacuum long")
        if s.name == "table_list":
            rows = [("main", t.name, "table", len(t.columns), int(t.without_rowid), int(t.strict)) for t in self.catalog.tables.values()]
            rows += [("main", v.name, "view", len(self.lowering().view(v.name.lower(), v).columns), 0, 0) for v in self.catalog.views.values()]
            return make([r for r in rows if s.arg is None or r[1].lower() == str(s.arg).lower()], "schema string, name string, type string, ncol long, wr long, strict long")
        if s.name in ("table_info", "table_xinfo"):
            t = self.catalog.table(str(s.arg))
            if t is None and str(s.arg).lower() in self.catalog.views:
                v = self.catalog.views[str(s.arg).lower()]
                cols = [TableColumn(c.label, c.ty, declared={"int": "INT", "real": "REAL", "text": "TEXT"}.get(c.ty, "")) for c in self.lowering().view(v.name.lower(), v).columns]
            else:
                cols = t.columns if t else []
            rows = [(i, c.label, c.declared.upper() if c.declared.upper() in STANDARD_TYPES else c.declared, int(bool(c.notnull)), c.default_text, c.pk, 0 if c.generated is None else 3 if c.stored else 2) for i, c in enumerate(cols)]
            if s.name == "table_info":
                return make([r[:6] for r in rows if not r[6]], "cid long, name string, type string, notnull long, dflt_value string, pk long")
            return make(rows, "cid long, name string, type string, notnull long, dflt_value string, pk long, hidden long")
        if s.name == "index_list":
            t = self._table(str(s.arg), False)
            keys = [k for k in reversed(t.keys) if not (k.origin == "pk" and t.rowid_alias)]
            return make([(i, k.name, int(k.unique), k.origin, int(k.where is not None)) for i, k in enumerate(keys)], "seq long, name string, unique long, origin string, partial long")
        if s.name in ("index_info", "index_xinfo"):
            for t in self.catalog.tables.values():
                for k in t.keys:
                    if k.name.lower() == str(s.arg).lower():
                        rows = []
                        for i, e in enumerate(k.terms):
                            coll = e.name if e.kind == "collate" else None
                            e = e.of if e.kind == "collate" else e
                            at = next((j for j, c in enumerate(t.columns) if e.kind == "name" and c.label.lower() == e.name.lower()), -2)
                            rows.append((i, at, t.columns[at].label if at >= 0 else None, int(i < len(k.desc) and k.desc[i]), coll or (t.columns[at].coll if at >= 0 else None) or "BINARY", 1))
                        if s.name == "index_info":
                            return make([r[:3] for r in rows], "seqno long, cid long, name string")
                        rows.append((len(rows), -1, None, 0, "BINARY", 0))
                        return make(rows, "seqno long, cid long, name string, desc long, coll string, key long")
            return Result([], None)
        raise SqlError(f"unsupported pragma {s.name}")


def _type(ty: str) -> T.DataType:
    if ty == "cell":
        return T.StructType.fromDDL("k int, d double, i bigint, s string, b binary, t string")
    return {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "ts": T.TimestampType(), "bool": T.BooleanType()}.get(ty, T.StringType())


def _names(e) -> set[str]:
    """Lower-case column names in an expression."""
    if isinstance(e, (list, tuple)):
        return set().union(*map(_names, e)) if e else set()
    if not isinstance(e, Node):
        return set()
    own = {e.name.lower()} if e.kind == "name" else set()
    return own.union(*[_names(v) for v in vars(e).values() if isinstance(v, (Node, list, tuple))])


def _rename(e, kind: str, old: str, new: str) -> None:
    if isinstance(e, (list, tuple)):
        for x in e:
            _rename(x, kind, old, new)
    elif isinstance(e, Node):
        if e.kind == kind and e.name.lower() == old:
            e.name = new
        if kind == "table" and e.kind == "name" and e.table and e.table.lower() == old:
            e.table = new
        for v in vars(e).values():
            if isinstance(v, (Node, list, tuple)):
                _rename(v, kind, old, new)


def _has_query(e) -> bool:
    """Whether a subquery stands anywhere in e."""
    if isinstance(e, (list, tuple)):
        return any(map(_has_query, e))
    if not isinstance(e, Node):
        return False
    return e.kind in ("subquery", "exists", "in_query", "select") or any(_has_query(v) for v in vars(e).values() if isinstance(v, (Node, list, tuple)))
