"""Scalar semantics as Spark SQL text: every helper takes and gives expressions, so all of it stays in the JVM's generated code."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from sedge.sql.lexer import SqlError

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A number at the start of a text, after white space.
PREFIX = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
INT_PREFIX = r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)"
WHOLE = r"^[ \t\n\x0B\f\r]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\n\x0B\f\r]*$"


@dataclass(frozen=True)
class E:
    """A bound expression: Spark SQL text, type (int, real, text, blob, bool, ts, null), affinity, collation."""

    sql: str
    ty: str
    aff: str | None = None
    coll: str | None = None
    explicit: bool = False
    narrow: bool = False
    items: tuple = ()
    agg: bool = False
    literal: object = field(default=None, compare=False)
    #: Of integer arithmetic that may leave 64 bits: the integer, NULL beyond them, and the real that the value then is.
    #: `sql` raises there: it stands where a value must have the one type of its column.
    soft: str | None = None
    wide: str | None = None
    #: What an integer cannot exceed, where that is known.
    most: int | None = field(default=None, compare=False)


def lit_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\0", "\\u0000") + "'"


def literal(v) -> E:
    if v is None:
        return E("NULL", "null")
    if isinstance(v, bool):
        v = int(v)
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            return literal(float(v))
        return E(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)", "int", literal=v, most=abs(v))
    if isinstance(v, float):
        if v != v:
            return E("NULL", "null")
        if v in (float("inf"), float("-inf")):
            return E(f"CAST('{'-' if v < 0 else ''}Infinity' AS DOUBLE)", "real", literal=v)
        return E(f"{v!r}D", "real", literal=v)
    if isinstance(v, (bytes, bytearray)):
        return E(f"X'{bytes(v).hex()}'", "blob", literal=bytes(v))
    return E(lit_text(str(v)), "text", literal=str(v))


def boolean(sql: str, **more) -> E:
    return E(sql, "bool", **more)


# --- cells: values of any class in one column ---

#: A cell: class for the order (1 numbers, 2 text, 3 blobs), the number as a real and as an integer, text, bytes, name of the class.
#: Structs compare field by field, so that cells without their names compare as the dialect's values do, integers exactly.
CELL = "struct<k:int,d:double,i:bigint,s:string,b:binary,t:string>"


def _cell(k: int, t: str, d: str = "NULL", i: str = "NULL", s: str = "NULL", b: str = "NULL") -> str:
    return f"named_struct('k', {k}, 'd', CAST({d} AS DOUBLE), 'i', CAST({i} AS BIGINT), 's', CAST({s} AS STRING), 'b', CAST({b} AS BINARY), 't', '{t}')"


def cell(e: E) -> str:
    """A value of a known class as a cell; NULL stays NULL."""
    if e.ty == "cell":
        return e.sql
    if e.ty == "null":
        return f"CAST(NULL AS {CELL})"
    if e.wide:
        return f"CASE WHEN {e.soft} IS NOT NULL THEN {_cell(1, 'integer', e.soft, e.soft)} WHEN {e.wide} IS NOT NULL THEN {cell(E(e.wide, 'real'))} END"
    made = {
        "int": lambda: _cell(1, "integer", out(e), out(e)), "bool": lambda: _cell(1, "integer", out(e), out(e)), "real": lambda: _cell(1, "real", e.sql, integer(e)),
        "blob": lambda: _cell(3, "blob", b=e.sql),
    }.get(e.ty, lambda: _cell(2, "text", s=text(e)))()
    return f"CASE WHEN {e.sql} IS NOT NULL THEN {made} END"


def cell_key(e: E, coll: str | None = None) -> str:
    """What of a cell is compared: all but the name of its class, text under its collation."""
    c = cell(e)
    return f"CASE WHEN {c} IS NOT NULL THEN named_struct('k', ({c}).k, 'd', ({c}).d, 'i', ({c}).i, 's', {collated(f'({c}).s', coll or e.coll)}, 'b', ({c}).b) END"


def shown(sql: str) -> str:
    """A cell at the end of a query: a variant of its own class."""
    return f"CASE {sql}.t WHEN 'integer' THEN CAST({sql}.i AS VARIANT) WHEN 'real' THEN CAST({sql}.d AS VARIANT) WHEN 'text' THEN CAST({sql}.s AS VARIANT) WHEN 'blob' THEN CAST({sql}.b AS VARIANT) END"


# --- conversions ---


def out(e: E) -> str:
    """At a result or an argument: truth values are integers."""
    return f"CAST({e.sql} AS BIGINT)" if e.ty == "bool" else e.sql


def truth(e: E) -> str:
    if e.items:
        raise SqlError("row value misused")
    if e.ty == "bool":
        return e.sql
    if e.ty == "null":
        return "CAST(NULL AS BOOLEAN)"
    if e.wide:
        return f"({real(e)} <> 0)"
    if e.ty in ("int", "real"):
        return f"({e.sql} <> 0)"
    return f"({real(e)} <> 0)"


def real_text(x: str) -> str:
    """Shortest digits that give the number back, a point always, exponents of two digits from 1e+16 and below 1e-4."""
    sci = f"regexp_replace(regexp_replace(CAST({x} AS STRING), 'E(-?)([0-9])$', 'E$10$2'), 'E([0-9])', 'E+$1')"
    return (
        f"CASE WHEN {x} = CAST('Infinity' AS DOUBLE) THEN 'Inf' WHEN {x} = CAST('-Infinity' AS DOUBLE) THEN '-Inf' WHEN {x} = 0 THEN '0.0' "
        f"WHEN abs({x}) < 1e15D AND {x} = floor({x}) THEN concat(CAST(CAST({x} AS BIGINT) AS STRING), '.0') "
        f"WHEN abs({x}) >= 1e-4D AND abs({x}) < 1e15D THEN CASE WHEN CAST({x} AS STRING) LIKE '%E%' THEN rtrim('0', CAST(CAST({x} AS DECIMAL(38, 20)) AS STRING)) ELSE CAST({x} AS STRING) END "
        f"ELSE lower({sci}) END"
    )


def text(e: E) -> str:
    if e.ty == "text":
        return e.sql
    if e.ty == "null":
        return "CAST(NULL AS STRING)"
    if e.ty == "real":
        return real_text(e.sql)
    if e.ty == "blob":
        return f"decode({e.sql}, 'UTF-8')"
    if e.ty == "cell":
        return f"CASE {e.sql}.t WHEN 'integer' THEN CAST({e.sql}.i AS STRING) WHEN 'real' THEN {real_text(f'{e.sql}.d')} WHEN 'text' THEN {e.sql}.s ELSE decode({e.sql}.b, 'UTF-8') END"
    if e.ty == "ts":
        return f"date_format({e.sql}, 'yyyy-MM-dd HH:mm:ss')"
    if e.wide:
        return f"coalesce(CAST({e.soft} AS STRING), {real_text(e.wide)})"
    return f"CAST({out(e)} AS STRING)"


def real(e: E) -> str:
    """As a number: text and blobs by their prefix, else 0."""
    if e.ty == "real":
        return e.sql
    if e.ty == "null":
        return "CAST(NULL AS DOUBLE)"
    if e.wide:
        return f"coalesce(CAST({e.soft} AS DOUBLE), {e.wide})"
    if e.ty == "cell":
        return f"CASE WHEN {e.sql}.k = 1 THEN {e.sql}.d ELSE {real(E(f'CASE WHEN {e.sql}.k = 2 THEN {e.sql}.s ELSE decode({e.sql}.b, {lit_text('UTF-8')}) END', 'text'))} END"
    if e.ty in ("int", "bool"):
        return f"CAST({out(e)} AS DOUBLE)"
    t = text(e)
    return f"CASE WHEN {t} IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract({t}, {lit_text(PREFIX)}, 1), '') AS DOUBLE), 0D) END"


def integer(e: E) -> str:
    """As an integer: reals truncate and saturate, text by its integer prefix."""
    if e.wide:
        return f"coalesce({e.soft}, {integer(E(e.wide, 'real'))})"
    if e.ty == "int":
        return f"CAST({e.sql} AS BIGINT)" if e.narrow else e.sql
    if e.ty == "bool":
        return out(e)
    if e.ty == "null":
        return "CAST(NULL AS BIGINT)"
    if e.ty == "real":
        return f"CASE WHEN {e.sql} >= 9223372036854775807D THEN 9223372036854775807L WHEN {e.sql} <= -9223372036854775808D THEN (-9223372036854775807L - 1L) ELSE CAST({e.sql} AS BIGINT) END"
    if e.ty == "cell":
        return f"CASE WHEN {e.sql}.k = 1 THEN {e.sql}.i ELSE {integer(E(f'CASE WHEN {e.sql}.k = 2 THEN {e.sql}.s ELSE decode({e.sql}.b, {lit_text('UTF-8')}) END', 'text'))} END"
    t = text(e)
    big = f"try_cast(nullif(regexp_extract({t}, {lit_text(INT_PREFIX)}, 1), '') AS DECIMAL(38, 0))"
    return (
        f"CASE WHEN {t} IS NULL THEN NULL WHEN {big} IS NULL THEN 0L WHEN {big} > 9223372036854775807 THEN 9223372036854775807L "
        f"WHEN {big} < -9223372036854775808 THEN (-9223372036854775807L - 1L) ELSE CAST({big} AS BIGINT) END"
    )


def whole_number(e: E) -> str:
    """Text that is a number throughout, else NULL."""
    return f"CASE WHEN {e.sql} RLIKE {lit_text(WHOLE)} THEN try_cast(trim({e.sql}) AS DOUBLE) END"


def affinity(type_name: str) -> str:
    t = (type_name or "").upper()
    if "INT" in t:
        return "int"
    if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if not t or "BLOB" in t:
        return "blob"
    if any(x in t for x in ("REAL", "FLOA", "DOUB")):
        return "real"
    return "numeric"


def cast(e: E, type_name: str) -> E:
    aff = affinity(type_name)
    if aff == "int":
        return E(integer(e), "int", "int")
    if aff == "real":
        return E(real(e), "real", "real")
    if aff == "text":
        return E(text(e), "text", "text", e.coll)
    if aff == "blob":
        return replace(e, aff="blob", literal=None) if e.ty in ("blob", "null") else E(f"CASE WHEN {e.sql}.k = 3 THEN {e.sql}.b ELSE encode({text(e)}, 'UTF-8') END", "blob", "blob") if e.ty == "cell" else E(f"encode({text(e)}, 'UTF-8')", "blob", "blob")
    if e.ty in ("int", "real"):
        return replace(e, aff="numeric", literal=None)
    return E(real(e), "real", "numeric")


# --- collation ---


def collated(sql: str, coll: str | None) -> str:
    if coll == "NOCASE":
        return f"translate({sql}, '{UPPER}', '{LOWER}')"
    if coll == "RTRIM":
        return f"rtrim(' ', {sql})"
    if coll in (None, "BINARY"):
        return sql
    raise SqlError(f"no such collation sequence: {coll}")


def collation(a: E, b: E | None = None) -> str | None:
    """An explicit collation first, the left one before the right, then that of a column, the left one first."""
    both = [x for x in (a, b) if x is not None]
    return next((x.coll for x in both if x.explicit), None) or next((x.coll for x in both if x.coll), None)


def key(e: E, coll: str | None = None) -> str:
    """What stands for the value where values are compared as wholes: groups, distinct rows, order."""
    if e.ty == "cell":
        return cell_key(e, coll)
    return collated(e.sql, coll or e.coll) if e.ty == "text" else e.sql


# --- operators ---


def numeric(e: E) -> E:
    """For arithmetic: text becomes a real, truth an integer, a narrow integer a wide one."""
    if e.items:
        raise SqlError("row value misused")
    if e.wide:
        return e
    if e.ty in ("int", "bool", "null"):
        return E(integer(e), "int", literal=e.literal, most=1 if e.ty == "bool" else 1 << 31 if e.narrow else e.most)
    return E(real(e), "real", literal=e.literal)


def number(sql: str) -> E:
    """A real result; not-a-number is NULL."""
    return E(f"nanvl({sql}, CAST(NULL AS DOUBLE))", "real")


def arith(op: str, a: E, b: E) -> E:
    agg = a.agg or b.agg
    x, y = numeric(a), numeric(b)
    ints = x.ty == y.ty == "int"
    if op == "%":
        i, j = integer(x), integer(y)
        s = f"CASE WHEN {j} = 0 THEN NULL WHEN {j} = -1 THEN 0L ELSE {i} % {j} END"
        return E(s, "int", agg=agg) if ints else E(f"CAST({s} AS DOUBLE)", "real", agg=agg)
    if ints:
        sx, sy = x.soft or x.sql, y.soft or y.sql
        if op != "/":
            if isinstance(x.literal, int) and isinstance(y.literal, int):
                return replace(literal(x.literal + y.literal if op == "+" else x.literal - y.literal if op == "-" else x.literal * y.literal), agg=agg)
            if x.most is not None and y.most is not None and (most := x.most * y.most if op == "*" else x.most + y.most) < 1 << 63:
                return E(f"({x.sql} {op} {y.sql})", "int", agg=agg, most=most)
            soft = f"{ {'+': 'try_add', '-': 'try_subtract', '*': 'try_multiply'}[op]}({sx}, {sy})"
            return E(f"({x.sql} {op} {y.sql})", "int", agg=agg, soft=soft, wide=f"({real(x)} {op} {real(y)})")
        if isinstance(x.literal, int) and isinstance(y.literal, int):
            if not y.literal:
                return E("CAST(NULL AS BIGINT)", "int", agg=agg)
            q = abs(x.literal) // abs(y.literal)
            return replace(literal(q if (x.literal < 0) == (y.literal < 0) else -q), agg=agg)
        if isinstance(y.literal, int) and y.literal not in (0, -1) and not x.wide:
            return E(f"({x.sql} DIV {y.sql})", "int", agg=agg, most=x.most)
        hard = f"CASE WHEN {y.sql} = 0 THEN NULL ELSE {x.sql} DIV {y.sql} END"
        if not x.wide and not y.wide and x.most is not None and x.most < 1 << 63:
            return E(hard, "int", agg=agg, most=x.most)
        soft = f"CASE WHEN {sy} = 0 THEN NULL WHEN {sy} = -1 THEN try_subtract(0L, {sx}) ELSE {sx} DIV {sy} END"
        return E(hard, "int", agg=agg, soft=soft, wide=f"CASE WHEN {real(y)} = 0 THEN NULL ELSE {real(x)} / {real(y)} END")
    p, q = real(x), real(y)
    if op == "/":
        return replace(number(f"CASE WHEN {q} = 0 THEN NULL ELSE {p} / {q} END"), agg=agg)
    return replace(number(f"({p} {op} {q})"), agg=agg)


def negative(a: E) -> E:
    n = numeric(a)
    if isinstance(n.literal, (int, float)) and n.literal is not None:
        return replace(literal(-n.literal), agg=a.agg)
    if n.ty == "real" or n.most is not None and n.most < 1 << 63 and not n.wide:
        return E(f"(-{n.sql})", n.ty, agg=a.agg, most=n.most)
    return E(f"(-{n.sql})", "int", agg=a.agg, soft=f"try_subtract(0L, {n.soft or n.sql})", wide=f"(-{real(n)})")


def is_null(e: E) -> str:
    return f"({real(e) if e.wide else out(e)} IS NULL)"


def bits(op: str, a: E, b: E) -> E:
    x, y = integer(a), integer(b)
    agg = a.agg or b.agg
    if op in "&|":
        return E(f"({x} {op} {y})", "int", agg=agg)
    left = f"shiftleft({x}, CAST(least(abs({y}), 63L) AS INT))"
    right = f"shiftright({x}, CAST(least(abs({y}), 63L) AS INT))"
    far = f"(({y}) > 63 OR ({y}) < -63)"
    if op == "<<":
        s = f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {y} >= 0 THEN CASE WHEN {far} THEN 0L ELSE {left} END ELSE {right} END"
    else:
        s = f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {y} >= 0 THEN {right} ELSE CASE WHEN {far} THEN 0L ELSE {left} END END"
    return E(s, "int", agg=agg)


_RANK = {"int": 1, "real": 1, "bool": 1, "text": 2, "ts": 2, "blob": 3}
_NUMERIC = ("int", "real", "numeric")


def _exact(op: str, i: E, r: E, swapped: bool) -> str:
    """An integer against a real without rounding the integer."""
    flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    o = flip.get(op, op) if swapped else op
    n = integer(i)
    if isinstance(r.literal, float) and abs(r.literal) < 1 << 52 or isinstance(i.literal, int) and abs(i.literal) < 1 << 52:
        return f"(CAST({n} AS DOUBLE) {o} {r.sql})"
    tie = f"({n} {o} CAST({r.sql} AS BIGINT))"
    return f"CASE WHEN CAST({n} AS DOUBLE) = {r.sql} AND abs({r.sql}) < 9.2e18D THEN {tie} ELSE CAST({n} AS DOUBLE) {o} {r.sql} END"


def compare(op: str, a: E, b: E, unaffected: bool = False) -> E:
    """=, <>, <, <=, > or >= with the affinities of both sides and a collation; NULL if a side is NULL."""
    if a.items or b.items:
        return rows_compare(op, a, b)
    agg = a.agg or b.agg
    done = lambda s: E(s, "bool", agg=agg)
    if "null" in (a.ty, b.ty):
        return done("CAST(NULL AS BOOLEAN)")
    if "cell" in (a.ty, b.ty):
        c = collation(a, b)
        for x, y, swapped in ((a, b, False), (b, a, True)):
            if x.ty == "cell" and y.aff == "text" and not unaffected:  # a column of text compares numbers as text
                t = E(f"CASE WHEN {x.sql}.k = 3 THEN NULL ELSE {text(x)} END", "text")
                return done(f"({collated(t.sql, c)} {op} {collated(text(y), c)})" if not swapped else f"({collated(text(y), c)} {op} {collated(t.sql, c)})")
        return done(f"({cell_key(a, c)} {op} {cell_key(b, c)})")
    for x, y, swapped in ((a, b, False), (b, a, True)):
        if x.ty == "ts" and y.ty == "text" and isinstance(y.literal, str):
            stamp = f"try_cast({y.sql} AS TIMESTAMP)"
            return done(f"({stamp} {op} {x.sql})" if swapped else f"({x.sql} {op} {stamp})")
    if a.ty == b.ty == "ts":
        return done(f"({a.sql} {op} {b.sql})")
    ra, rb = _RANK[a.ty], _RANK[b.ty]
    if ra == rb == 1 and (a.wide or b.wide):
        reals = f"({real(a)} {op} {real(b)})"
        if "real" in (a.ty, b.ty):
            i, r = (a, b) if b.ty == "real" else (b, a)
            return done(f"coalesce({_exact(op, E(i.soft, 'int'), r, r is a)}, {reals})")
        # A value beyond 64 bits is past every integer on its side.
        i, j = a.soft or out(a), b.soft or out(b)
        past = "".join(f" WHEN {x} IS NULL THEN ({f'sign({w}) {op} 0' if first else f'0 {op} sign({w})'})" for x, w, first in ((i, a.wide, True), (j, b.wide, False)) if w)
        both = f" WHEN {i} IS NULL AND {j} IS NULL THEN {reals}" if a.wide and b.wide else ""
        return done(f"CASE WHEN {real(a)} IS NULL OR {real(b)} IS NULL THEN NULL{both}{past} ELSE ({i} {op} {j}) END")
    if ra == rb == 1:
        if "real" in (a.ty, b.ty) and a.ty != b.ty:
            return done(_exact(op, a, b, False) if b.ty == "real" else _exact(op, b, a, True))
        return done(f"({out(a)} {op} {out(b)})")
    if ra == rb == 2:
        c = collation(a, b)
        x, y = collated(text(a), c), collated(text(b), c)
        return done(f"({x} {op} {y})")
    if ra == rb:
        return done(f"({a.sql} {op} {b.sql})")
    low = {"=": "false", "<>": "true", "<": "true", "<=": "true", ">": "false", ">=": "false"}
    high = {"=": "false", "<>": "true", "<": "false", "<=": "false", ">": "true", ">=": "true"}
    fixed = f"CASE WHEN {a.sql} IS NULL OR {b.sql} IS NULL THEN NULL ELSE {(low if ra < rb else high)[op]} END"
    if {ra, rb} == {1, 2} and not unaffected:
        n, t = (a, b) if ra == 1 else (b, a)
        if n.aff in _NUMERIC:
            w = E(whole_number(E(text(t), "text")), "real")
            same = compare(op, *((n, w) if n is a else (w, n)))
            return done(f"CASE WHEN {w.sql} IS NOT NULL THEN {same.sql} ELSE {fixed} END")
        if t.aff == "text":
            c = collation(a, b)
            return done(f"({collated(text(a), c)} {op} {collated(text(b), c)})")
    return done(fixed)


def rows_compare(op: str, a: E, b: E) -> E:
    """Row values by their components, three-valued; a definite difference beats a NULL."""
    if len(a.items) != len(b.items):
        raise SqlError("row value misused")
    pairs = list(zip(a.items, b.items))
    if op in ("=", "<>"):
        s = " AND ".join(compare("=", x, y).sql for x, y in pairs)
        return boolean(f"({s})" if op == "=" else f"(NOT ({s}))")
    strict = op[0]
    x, y = pairs[-1]
    s = compare(op, x, y).sql
    for x, y in reversed(pairs[:-1]):
        s = f"CASE WHEN {out(x)} IS NULL OR {out(y)} IS NULL THEN NULL WHEN {compare('<>', x, y).sql} THEN {compare(strict, x, y).sql} ELSE {s} END"
    return boolean(s)


def is_(a: E, b: E, negated: bool) -> E:
    if a.items or b.items:
        if len(a.items) != len(b.items):
            raise SqlError("row value misused")
        s = " AND ".join(is_(x, y, False).sql for x, y in zip(a.items, b.items))
        return boolean(f"(NOT ({s}))" if negated else f"({s})")
    agg = a.agg or b.agg
    if b.ty == "null":
        return E(f"(NOT {is_null(a)})" if negated else is_null(a), "bool", agg=agg)
    if a.ty == "null":
        return E(f"(NOT {is_null(b)})" if negated else is_null(b), "bool", agg=agg)
    eq = compare("=", a, b).sql
    s = f"coalesce({eq}, {is_null(a)} AND {is_null(b)})"
    return E(f"(NOT {s})" if negated else s, "bool", agg=agg)


def like(e: E, pattern: E, escape: str | None) -> E:
    """% and _ with ASCII letters of either case."""
    x, p = collated(text(e), "NOCASE"), collated(text(pattern), "NOCASE")
    if isinstance(pattern.literal, str):
        s = pattern.literal
        body, i = [], 0
        while i < len(s):
            if escape and s[i] == escape:
                if i + 1 == len(s):
                    return boolean(f"CASE WHEN {x} IS NULL THEN NULL ELSE false END", agg=e.agg)
                body.append("\\" + s[i + 1].translate(str.maketrans(UPPER, LOWER)) if s[i + 1] in "%_\\" else s[i + 1].translate(str.maketrans(UPPER, LOWER)))
                i += 2
                continue
            body.append("\\\\" if s[i] == "\\" else s[i].translate(str.maketrans(UPPER, LOWER)))
            i += 1
        return boolean(f"({x} LIKE {lit_text(''.join(body))})", agg=e.agg)
    if escape is None:
        return boolean(f"({x} LIKE replace({p}, {lit_text(chr(92))}, {lit_text(chr(92) * 2)}))", agg=e.agg)
    return boolean(f"({x} LIKE {p} ESCAPE {lit_text(escape)})", agg=e.agg)


def glob_regex(pattern: str) -> str | None:
    """Java regular expression of a GLOB pattern; None if it can't match: a class is left open."""
    import re

    def quoted(c: str) -> str:
        return re.sub(r"([\\^$.|?*+()\[\]{}&-])", r"\\\1", c)

    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] == "^"
            j += negated
            members: list[str] = []
            if pattern[j : j + 1] == "]":
                members, j = ["]"], j + 1
            while j < len(pattern) and pattern[j] != "]":
                if pattern[j] == "-" and members and pattern[j + 1 : j + 2] not in ("]", ""):
                    # A backward range holds its first character only, which stands already.
                    if members[-1] <= pattern[j + 1]:
                        members.append(f"{members[-1]}-{pattern[j + 1]}")
                    j += 2
                    continue
                members.append(pattern[j])
                j += 1
            if j >= len(pattern):
                return None
            body = "".join(quoted(m) if len(m) == 1 else f"{quoted(m[0])}-{quoted(m[2])}" for m in members)
            out.append(f"[{'^' if negated else ''}{body}]" if body else ("." if negated else "(?!)"))
            i = j
        else:
            out.append(quoted(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def glob(e: E, pattern: E) -> E:
    """A literal pattern becomes a regular expression here; one of a column is translated by Spark, piece by piece: classes
    with their ranges (backward ones hold their first character), runs of plain characters, * and ?."""
    x = text(e)
    if isinstance(pattern.literal, str):
        r = glob_regex(pattern.literal)
        return boolean(f"CASE WHEN {x} IS NULL THEN NULL ELSE false END" if r is None else f"({x} RLIKE {lit_text(r)})", agg=e.agg)
    p = text(pattern)
    class_ = r"\[\^?+\]?+[^\]]*+\]"
    pieces = f"regexp_extract_all({p}, {lit_text('(?s)' + class_ + '|.')}, 0)"
    inner = "regexp_extract(q, '(?s)^\\\\[\\\\^?(.*)\\\\]$', 1)"
    esc = lambda v: f"regexp_replace({v}, {lit_text('([^A-Za-z0-9])')}, {lit_text(chr(92) * 2 + '$1')})"
    ranged = f"regexp_extract_all({inner}, {lit_text('(?s)(.)-(.)|.')}, 0)"
    member = (
        f"CASE WHEN length(m) < 3 THEN {esc('m')} WHEN substring(m, 1, 1) <= substring(m, 3, 1) THEN concat({esc('substring(m, 1, 1)')}, '-', {esc('substring(m, 3, 1)')}) "
        f"ELSE {esc('substring(m, 1, 1)')} END"
    )
    body = f"array_join(transform({ranged}, m -> {member}), '')"
    one = (
        f"CASE WHEN q = '*' THEN '.*' WHEN q = '?' THEN '.' WHEN length(q) > 1 THEN concat('[', CASE WHEN substring(q, 2, 1) = '^' THEN '^' ELSE '' END, {body}, ']') "
        f"WHEN q = '[' THEN '(?!)' ELSE {esc('q')} END"
    )
    r = f"concat('(?s)^', array_join(transform({pieces}, q -> {one}), ''), {lit_text(chr(92) + 'z')})"
    return boolean(f"({x} RLIKE {r})", agg=e.agg)


# --- functions ---


def substr(e: E, start: E, count: E | None) -> E:
    """Characters (bytes of a blob) from a place counted from 1, or from the end if negative; a negative count goes left."""
    s = e.sql if e.ty == "blob" else text(e)
    size = f"CAST({'octet_length' if e.ty == 'blob' else 'length'}({s}) AS BIGINT)"
    p = integer(start)
    if isinstance(start.literal, int) and start.literal > 0 and (count is None or isinstance(count.literal, int) and count.literal >= 0):
        n = "" if count is None else f", {min(count.literal, 2**31 - 1)}"
        return E(f"substring({s}, {min(start.literal, 2**31 - 1)}{n})", "blob" if e.ty == "blob" else "text", agg=e.agg)
    # In half-open places from 0: the span of the asked characters, then its overlap with the value.
    n = "4611686018427387904L" if count is None else integer(count)
    first = f"CASE WHEN {p} < 0 THEN {size} + {p} WHEN {p} > 0 THEN {p} - 1 ELSE -1L END" if count is not None else f"CASE WHEN {p} < 0 THEN {size} + {p} WHEN {p} > 0 THEN {p} - 1 ELSE 0L END"
    low = f"CASE WHEN {n} < 0 THEN ({first0(p, size)}) + {n} ELSE ({first}) END"
    high = f"CASE WHEN {n} < 0 THEN ({first0(p, size)}) ELSE ({first}) + {n} END"
    a, b = f"greatest(0L, least({size}, {low}))", f"greatest(0L, least({size}, {high}))"
    null = f"{s} IS NULL OR {p} IS NULL" + ("" if count is None else f" OR {n} IS NULL")
    empty = "X''" if e.ty == "blob" else "''"
    return E(
        f"CASE WHEN {null} THEN NULL WHEN {b} <= {a} THEN {empty} ELSE substring({s}, CAST({a} + 1 AS INT), CAST({b} - {a} AS INT)) END",
        "blob" if e.ty == "blob" else "text", agg=e.agg,
    )


def first0(p: str, size: str) -> str:
    """The place that a negative count goes left from."""
    return f"CASE WHEN {p} < 0 THEN {size} + {p} WHEN {p} > 0 THEN {p} - 1 ELSE 0L END"


def length(e: E) -> str:
    if e.ty == "blob":
        return f"CAST(octet_length({e.sql}) AS BIGINT)"
    if e.ty == "cell":
        return f"CASE WHEN {e.sql}.k = 3 THEN CAST(octet_length({e.sql}.b) AS BIGINT) ELSE {length(E(text(e), 'text'))} END"
    t = text(e)
    return f"CAST(length(CASE WHEN instr({t}, '\\u0000') > 0 THEN substring_index({t}, '\\u0000', 1) ELSE {t} END) AS BIGINT)"


def common(parts: list[E]) -> str:
    """The type of a choice among values; text if they have no other in common."""
    kinds = {("int" if p.ty == "bool" else p.ty) for p in parts if p.ty != "null"}
    if not kinds:
        return "null"
    if "cell" in kinds:
        return "cell"
    if len(kinds) == 1:
        return kinds.pop()
    return "real" if kinds <= {"int", "real"} else "text"


def as_type(e: E, ty: str) -> str:
    if ty == "cell":
        return cell(e)
    if ty == "real":
        return real(e)
    if ty == "text":
        return text(e)
    if ty == "int":
        return integer(e) if e.narrow or e.ty == "null" else out(e)
    return e.sql


def choice(parts: list[E], build) -> E:
    ty = common(parts)
    if ty == "int" and all(p.narrow or p.ty == "null" for p in parts):
        return E(build([p.sql for p in parts]), ty, narrow=True, agg=any(p.agg for p in parts))
    return E(build([as_type(p, ty) for p in parts]), ty, coll=parts[0].coll if ty == "text" else None, agg=any(p.agg for p in parts))


def minmax(name: str, args: list[E]) -> E:
    """Of two or more: NULL if any is NULL; compared under the first collation."""
    nulls = " OR ".join(f"{out(a)} IS NULL" for a in args)
    ty = common(args)
    coll = next((a.coll for a in args if a.coll), None)
    fn = "least" if name == "min" else "greatest"
    vals = [as_type(a, ty) for a in args]
    if ty == "text" and coll not in (None, "BINARY"):
        order = ", ".join(f"struct({collated(v, coll)} AS k, {(i if name == 'min' else -i)} AS i, {v} AS v)" for i, v in enumerate(vals))
        body = f"{fn}({order}).v"
    else:
        body = f"{fn}({', '.join(vals)})"
    return E(f"CASE WHEN {nulls} THEN NULL ELSE {body} END", ty, coll=coll, agg=any(a.agg for a in args))


def char(args: list[E]) -> E:
    """Code points by UTF-32; what is none becomes U+FFFD."""
    parts = []
    for a in args:
        n = f"coalesce({integer(a)}, 0L)"
        ok = f"CASE WHEN {n} < 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN 65533L ELSE {n} END"
        parts.append(f"decode(unhex(lpad(hex({ok}), 8, '0')), 'UTF-32')")
    return E(f"concat({', '.join(parts)})" if parts else "''", "text")


_MATH = {"sqrt": "sqrt", "exp": "exp", "ln": "ln", "log10": "log10", "log2": "log2", "sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "degrees": "degrees", "radians": "radians"}


def stamp(args: list[E]) -> str:
    """A time value with modifiers; NULL where it can't be read."""
    if not args:
        return "current_timestamp()"
    a = args[0]
    if a.ty == "ts":
        t = a.sql
    elif a.ty in ("int", "real"):
        t = f"timestamp_micros(CAST(round(({real(a)} - 2440587.5D) * 86400000D) * 1000 AS BIGINT))"
    elif isinstance(a.literal, str) and a.literal.lower() == "now":
        t = "current_timestamp()"
    else:
        t = f"try_cast({text(a)} AS TIMESTAMP)"
    for m in args[1:]:
        if not isinstance(m.literal, str):
            raise SqlError("date modifiers must be literals")
        w = m.literal.lower().split()
        if w[:2] == ["start", "of"] and w[2:] in (["day"], ["month"], ["year"]):
            t = f"date_trunc('{w[2]}', {t})"
        elif len(w) == 2 and w[1].rstrip("s") in ("month", "year"):
            # A day beyond the month's end runs on into the next month.
            months = int(w[0]) * (12 if w[1].startswith("year") else 1)
            t = f"(date_trunc('month', {t}) + INTERVAL '{months}' MONTH + make_dt_interval(day({t}) - 1) + ({t} - date_trunc('day', {t})))"
        elif len(w) == 2 and w[1].rstrip("s") in ("day", "hour", "minute", "second"):
            t = f"({t} + INTERVAL '{float(w[0]) if w[1].startswith('second') else int(w[0])}' {w[1].rstrip('s').upper()})"
        elif w == ["unixepoch"]:
            t = f"timestamp_seconds({integer(args[0])})"
        elif w not in (["utc"], ["localtime"], ["auto"]):
            raise SqlError(f"unsupported date modifier {m.literal}")
    return t


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}


def strftime(fmt: E, args: list[E]) -> E:
    if not isinstance(fmt.literal, str):
        raise SqlError("strftime needs a literal format")
    t, parts, plain, i, f = stamp(args), [], "", 0, fmt.literal
    while i < len(f):
        if f[i] != "%":
            plain, i = plain + f[i], i + 1
            continue
        c, i = f[i + 1 : i + 2], i + 2
        if c == "%":
            plain += "%"
            continue
        if plain:
            parts.append(lit_text(plain))
            plain = ""
        if c in _STRFTIME:
            parts.append(f"date_format({t}, '{_STRFTIME[c]}')")
        elif c == "w":
            parts.append(f"CAST(dayofweek({t}) - 1 AS STRING)")
        elif c == "s":
            parts.append(f"CAST(unix_seconds({t}) AS STRING)")
        elif c == "W":  # weeks of the year from its first Monday
            parts.append(f"lpad(CAST((dayofyear({t}) + 6 - (dayofweek({t}) + 5) % 7) DIV 7 AS STRING), 2, '0')")
        elif c == "J":
            parts.append(real_text(f"(unix_millis({t}) / 86400000D + 2440587.5D)"))
        else:
            raise SqlError(f"unsupported strftime conversion %{c}")
    if plain:
        parts.append(lit_text(plain))
    return E(f"CASE WHEN {t} IS NOT NULL THEN concat({', '.join(parts)}) END" if parts else "''", "text")


def call(name: str, args: list[E], state: dict) -> E:
    """A scalar function."""
    n = len(args)

    def arity(low: int, high: int | None = None):
        if not low <= n <= (high if high is not None else low):
            raise SqlError(f"wrong number of arguments to function {name}()")

    if any(a.items for a in args):
        raise SqlError("row value misused")
    agg = any(a.agg for a in args)
    made = lambda s, ty, **k: E(s, ty, agg=agg, **k)
    if name == "typeof":
        arity(1)
        kind = {"int": "integer", "bool": "integer", "ts": "text"}.get(args[0].ty, args[0].ty)
        if args[0].ty == "cell":
            return made(f"coalesce({args[0].sql}.t, 'null')", "text")
        if args[0].wide:
            return made(f"CASE WHEN {args[0].soft} IS NOT NULL THEN 'integer' WHEN {args[0].wide} IS NOT NULL THEN 'real' ELSE 'null' END", "text")
        return made("'null'" if kind == "null" else f"CASE WHEN {args[0].sql} IS NULL THEN 'null' ELSE '{kind}' END", "text")
    if name == "length":
        arity(1)
        return made(length(args[0]), "int")
    if name == "octet_length":
        arity(1)
        return made(f"CAST(octet_length({args[0].sql if args[0].ty == 'blob' else text(args[0])}) AS BIGINT)", "int")
    if name == "hex":
        arity(1)
        return made(f"coalesce(hex({args[0].sql if args[0].ty == 'blob' else f'encode({text(args[0])}, {lit_text('UTF-8')})'}), '')", "text")
    if name == "unhex":
        arity(1, 2)
        t = text(args[0])
        if n == 2:
            t = f"translate({t}, {text(args[1])}, '')"
        return made(f"CASE WHEN length({t}) % 2 = 0 AND {t} RLIKE '^[0-9A-Fa-f]*$' THEN unhex({t}) END", "blob")
    if name in ("lower", "upper"):
        arity(1)
        a, b = (UPPER, LOWER) if name == "lower" else (LOWER, UPPER)
        return made(f"translate({text(args[0])}, '{a}', '{b}')", "text")
    if name == "abs":
        arity(1)
        return made(f"abs({integer(args[0])})", "int") if args[0].ty in ("int", "bool", "null") else made(f"abs({real(args[0])})", "real")
    if name == "unicode":
        arity(1)
        t = text(args[0])
        return made(f"CASE WHEN length({t}) > 0 THEN CAST(ascii({t}) AS BIGINT) END", "int")
    if name == "char":
        return made(char(args).sql, "text")
    if name in ("coalesce", "ifnull"):
        arity(2, 2 if name == "ifnull" else 127)
        return choice(args, lambda v: f"coalesce({', '.join(v)})")
    if name == "nullif":
        arity(2)
        return E(f"CASE WHEN {compare('=', replace(args[0], aff=None), replace(args[1], aff=None), True).sql} THEN NULL ELSE {out(args[0])} END", "int" if args[0].ty == "bool" else args[0].ty, coll=args[0].coll, agg=agg)
    if name in ("iif", "if"):
        arity(2, 127)
        conds, vals = args[0 : n - n % 2 : 2], args[1::2]
        other = [args[-1]] if n % 2 else []
        return choice([*vals, *other], lambda v: "CASE " + " ".join(f"WHEN {truth(c)} THEN {x}" for c, x in zip(conds, v)) + (f" ELSE {v[-1]}" if other else "") + " END")
    if name == "instr":
        arity(2)
        if args[0].ty == args[1].ty == "blob":
            h = [f"decode({a.sql}, 'ISO-8859-1')" for a in args]
            return made(f"CAST(instr({h[0]}, {h[1]}) AS BIGINT)", "int")
        return made(f"CAST(instr({text(args[0])}, {text(args[1])}) AS BIGINT)", "int")
    if name == "replace":
        arity(3)
        return made(f"replace({text(args[0])}, {text(args[1])}, {text(args[2])})", "text")
    if name in ("trim", "ltrim", "rtrim"):
        arity(1, 2)
        side = {"trim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[name]
        return made(f"trim({side} {text(args[1]) if n == 2 else lit_text(' ')} FROM {text(args[0])})", "text")
    if name in ("substr", "substring"):
        arity(2, 3)
        return replace(substr(args[0], args[1], args[2] if n == 3 else None), agg=agg)
    if name in ("min", "max"):
        arity(2, 127)
        return minmax(name, args)
    if name == "like":
        arity(2, 3)
        esc = args[2].literal if n == 3 else None
        if n == 3 and (not isinstance(esc, str) or len(esc) != 1):
            raise SqlError("ESCAPE expression must be a single character")
        return like(args[1], args[0], esc)
    if name == "glob":
        arity(2)
        return glob(args[1], args[0])
    if name in ("changes", "total_changes", "last_insert_rowid"):
        arity(0)
        return literal(state.get(name, 0))
    if name in _MATH:
        arity(1)
        x = real(args[0])
        return replace(number(f"{_MATH[name]}({x})" if name not in ("ln", "log10", "log2") else f"CASE WHEN {x} > 0 THEN {_MATH[name]}({x}) END"), agg=agg)
    if name in ("pow", "power", "atan2"):
        arity(2)
        return replace(number(f"{'atan2' if name == 'atan2' else 'pow'}({real(args[0])}, {real(args[1])})"), agg=agg)
    if name == "log":
        arity(1, 2)
        if n == 1:
            return call("log10", args, state)
        return replace(number(f"CASE WHEN {real(args[0])} > 0 AND {real(args[1])} > 0 THEN log({real(args[0])}, {real(args[1])}) END"), agg=agg)
    if name in ("ceil", "ceiling", "floor", "trunc"):
        arity(1)
        if args[0].ty in ("int", "bool"):
            return made(integer(args[0]), "int")
        x = real(args[0])
        f = {"ceil": f"ceil({x})", "ceiling": f"ceil({x})", "floor": f"floor({x})", "trunc": f"CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END"}[name]
        return made(f"CAST({f} AS DOUBLE)", "real")
    if name == "round":
        arity(1, 2)
        d = 0 if n == 1 else args[1].literal
        if not isinstance(d, int):
            raise SqlError("round needs a literal number of digits")
        return made(f"round({real(args[0])}, {max(d, 0)})", "real")
    if name == "sign":
        arity(1)
        return made(f"CAST(sign({real(args[0])}) AS BIGINT)", "int")
    if name == "mod":
        arity(2)
        return replace(number(f"CASE WHEN {real(args[1])} <> 0 THEN {real(args[0])} % {real(args[1])} END"), agg=agg)
    if name == "pi":
        arity(0)
        return made("pi()", "real")
    if name in ("date", "time", "datetime"):
        f = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}[name]
        return made(f"date_format({stamp(args)}, '{f}')", "text")
    if name == "strftime":
        arity(1, 127)
        return replace(strftime(args[0], args[1:]), agg=agg)
    if name == "julianday":
        return made(f"(unix_millis({stamp(args)}) / 86400000D + 2440587.5D)", "real")
    if name == "unixepoch":
        return made(f"unix_seconds({stamp(args)})", "int")
    if name == "json_extract":
        arity(2)
        return made(f"get_json_object({text(args[0])}, {text(args[1])})", "text")
    if name == "json_valid":
        arity(1)
        return made(f"CASE WHEN {text(args[0])} IS NULL THEN NULL ELSE CAST(try_parse_json({text(args[0])}) IS NOT NULL AS BIGINT) END", "int")
    if name == "json_type":
        arity(1, 2)
        v = f"try_variant_get(try_parse_json({text(args[0])}), {text(args[1]) if n == 2 else lit_text('$')}, 'variant')"
        s = f"schema_of_variant({v})"
        return made(
            f"CASE WHEN {v} IS NULL THEN NULL WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} = 'STRING' THEN 'text' WHEN {s} = 'BIGINT' THEN 'integer' "
            f"WHEN {s} = 'BOOLEAN' THEN CASE WHEN CAST({v} AS BOOLEAN) THEN 'true' ELSE 'false' END WHEN {s} = 'VOID' THEN 'null' ELSE 'real' END", "text")
    if name == "json_array_length":
        arity(1)
        return made(f"CAST(json_array_length({text(args[0])}) AS BIGINT)", "int")
    if name == "quote":
        arity(1)
        a = args[0]
        if a.ty in ("int", "real", "bool"):
            return made(f"coalesce({text(a)}, 'NULL')", "text")
        if a.ty == "null":
            return made("'NULL'", "text")
        if a.ty == "cell":
            of = {"integer": ("i", "int"), "real": ("d", "real"), "text": ("s", "text"), "blob": ("b", "blob")}
            arms = " ".join(f"WHEN '{t}' THEN {call('quote', [E(f'{a.sql}.{x}', ty)], state).sql}" for t, (x, ty) in of.items())
            return made(f"CASE {a.sql}.t {arms} ELSE 'NULL' END", "text")
        body = f"concat('X\\'', hex({a.sql}), '\\'')" if a.ty == "blob" else f"concat('\\'', replace({text(a)}, '\\'', '\\'\\''), '\\'')"
        return made(f"coalesce({body}, 'NULL')", "text")
    if name == "zeroblob":
        arity(1)
        return made(f"unhex(repeat('00', CAST({integer(args[0])} AS INT)))", "blob")
    if name == "soundex":
        arity(1)
        return made(f"coalesce(nullif(soundex({text(args[0])}), ''), '?000')", "text")
    if name == "printf" or name == "format":
        if not args or not isinstance(args[0].literal, str):
            raise SqlError("printf needs a literal format")
        return made(f"format_string({', '.join([args[0].sql.replace('%i', '%d'), *map(out, args[1:])])})", "text")
    raise SqlError(f"no such function: {name}")
