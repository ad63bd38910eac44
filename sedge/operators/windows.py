"""Window calls. ROWS and RANGE frames are Spark's; GROUPS frames become RANGE over a number of peers; EXCLUDE filters a gathered frame."""

from __future__ import annotations

from sedge.functions import scalar as S
from sedge.functions.scalar import E
from sedge.sql.lexer import SqlError
from sedge.sql.parser import Node


def _order(low, spec, scope) -> list[str]:
    out = []
    for t in spec.order:
        e = low.expr(t.expr, scope)
        out.append(low.order_key(S.key(e) if e.ty != "bool" else S.out(e), t))
    return out


def _bound(low, b, scope, high: bool) -> str:
    what, side = b
    if what == "unbounded":
        return f"UNBOUNDED {side.upper()}"
    if what == "current":
        return "CURRENT ROW"
    v = low.expr(what, scope)
    if not isinstance(v.literal, (int, float)) or v.literal < 0:
        raise SqlError("frame offset must be a non-negative number")
    return f"{v.literal} {side.upper()}"


def _id(low, spec: Node) -> str:
    return repr((spec.partition, spec.order))


def peer_columns(low, exprs, scope) -> list[tuple[str, str]]:
    """For each window with a GROUPS frame or an EXCLUDE: its number of peers and its row number, as columns below the query."""
    low.peer_keys, out = [], []

    def walk(e):
        if isinstance(e, (list, tuple)):
            for x in e:
                walk(x)
        elif isinstance(e, Node) and e.kind != "select":
            if e.kind == "call" and e.over is not None:
                spec = low.spec(e.over, scope)
                f = spec.frame
                if f and (f.unit == "groups" or f.exclude not in (None, "no")) and _id(low, spec) not in {k[0] for k in low.peer_keys}:
                    part = ", ".join(S.key(low.expr(p, scope)) for p in spec.partition)
                    order = ", ".join(_order(low, spec, scope))
                    over = f"OVER ({f'PARTITION BY {part} ' if part else ''}{f'ORDER BY {order}' if order else 'ORDER BY 1'})"
                    for kind, fn in (("peer", "dense_rank()"), ("row", "row_number()")):
                        low.peer_keys.append((_id(low, spec), kind))
                        out.append((f"p{len(out)}", f"{fn} {over}"))
            for v in vars(e).values():
                walk(v)

    walk(exprs)
    return out


def window(low, e, spec, scope) -> E:
    if e.distinct:
        raise SqlError("DISTINCT is not supported for window functions")
    args = [low.expr(a, scope) for a in e.args]
    name, frame = e.name, spec.frame
    part = ", ".join(S.key(low.expr(p, scope)) for p in spec.partition)
    order = _order(low, spec, scope)
    cond = S.truth(low.expr(e.filter, scope)) if e.filter is not None else None
    kept = lambda sql: f"CASE WHEN {cond} THEN {sql} END" if cond else sql
    excluded = bool(frame and frame.exclude not in (None, "no"))
    if frame and (frame.unit == "groups" or excluded):
        peer, row = low.peers[_id(low, spec), "peer"], low.peers[_id(low, spec), "row"]
    if frame and frame.unit == "groups":
        order, unit = [f"{peer} ASC"], "RANGE"
    else:
        unit = frame.unit.upper() if frame else ""
    clause = f" {unit} BETWEEN {_bound(low, frame.low, scope, False)} AND {_bound(low, frame.high, scope, True)}" if frame else ""
    over = f"OVER ({f'PARTITION BY {part} ' if part else ''}{'ORDER BY ' + ', '.join(order) if order else ''}{clause})"
    made = lambda sql, ty, **k: E(sql, ty, **k)
    ranked = f"OVER ({f'PARTITION BY {part} ' if part else ''}ORDER BY {', '.join(order) if order else '1'})"
    if name in ("row_number", "rank", "dense_rank"):
        return made(f"CAST({name}() {ranked} AS BIGINT)", "int")
    if name in ("percent_rank", "cume_dist"):
        return made(f"{name}() {ranked}", "real")
    if name == "ntile":
        return made(f"CAST(ntile({int(args[0].literal)}) {ranked} AS BIGINT)", "int")
    if name in ("lag", "lead"):
        k = args[1].literal if len(args) > 1 else 1
        other = f", {S.as_type(args[2], args[0].ty)}" if len(args) > 2 else ""
        return made(f"{name}({S.out(args[0])}, {int(k)}{other}) {ranked}", "int" if args[0].ty == "bool" else args[0].ty, coll=args[0].coll)
    if excluded:
        return _excluding(name, args, frame, peer, row, over, kept, part)
    if name in ("first_value", "last_value"):
        return made(f"{name}({S.out(args[0])}) {over}", args[0].ty, coll=args[0].coll)
    if name == "nth_value":
        return made(f"nth_value({S.out(args[0])}, {int(args[1].literal)}) {over}", args[0].ty)
    if name == "count":
        return made(f"count({kept(S.out(args[0]) if args else '1')}) {over}", "int")
    if name in ("sum", "avg", "total"):
        n = S.numeric(args[0])
        x = kept(n.sql if name == "sum" else S.real(n))
        if name == "total":
            return made(f"coalesce(sum({x}) {over}, 0D)", "real")
        return made(f"{name}({x}) {over}", n.ty if name == "sum" else "real")
    if name in ("min", "max"):
        return made(f"{name}({kept(S.out(args[0]))}) {over}", args[0].ty)
    if name in ("group_concat", "string_agg"):
        sep = S.text(args[1]) if len(args) > 1 else "','"
        return made(f"nullif(array_join(collect_list({kept(S.text(args[0]))}) {over}, {sep}), '')", "text")
    raise SqlError(f"{name}() may not be used as a window function")


def _excluding(name, args, frame, peer, row, over, kept, part) -> E:
    """The frame without what EXCLUDE names for the current row.

    Over a whole partition, counts are those of the partition less those of the excluded rows, and so are sums of integers;
    any other frame or function gathers the frame as a list of (peer, row, value).
    """
    n = S.numeric(args[0]) if args and name in ("sum", "avg", "total") else args[0] if args else S.literal(1)
    v = S.real(n) if name in ("avg", "total") else S.out(n)
    whole = frame.low[0] == frame.high[0] == "unbounded"
    if whole and (name == "count" or name == "sum" and n.ty == "int"):
        x = kept(v)
        every = f"OVER ({f'PARTITION BY {part}' if part else ''})"
        peers = f"OVER (PARTITION BY {f'{part}, ' if part else ''}{peer})"

        def left(fn: str, value: str) -> str:
            own = f"CASE WHEN {value} IS NULL THEN 0L ELSE {'1L' if fn == 'count' else value} END"
            out = {"current": own, "group": f"coalesce({fn}({value}) {peers}, 0L)", "ties": f"coalesce({fn}({value}) {peers}, 0L) - {own}"}[frame.exclude]
            return f"(coalesce({fn}({value}) {every}, 0L) - ({out}))"

        if name == "count":
            return E(f"CAST({left('count', x)} AS BIGINT)", "int")
        wide = f"CAST({x} AS DECIMAL(38, 0))"  # partial sums may pass 64 bits where the result does not
        return E(f"CASE WHEN {left('count', x)} > 0 THEN CAST({left('sum', wide)} AS BIGINT) END", n.ty)
    keep = {"current": f"f.r <> {row}", "group": f"f.p <> {peer}", "ties": f"(f.p <> {peer} OR f.r = {row})"}[frame.exclude]
    gathered = f"collect_list(struct({peer} AS p, {row} AS r, {kept(v)} AS v)) {over}"
    values = f"filter(transform(filter({gathered}, f -> {keep}), f -> f.v), v -> v IS NOT NULL)"
    zero = "0D" if name in ("avg", "total") or n.ty == "real" else "0L"
    total = f"aggregate({values}, {zero}, (a, b) -> a + b)"
    if name == "count":
        return E(f"CAST(size({values}) AS BIGINT)", "int")
    if name == "sum":
        return E(f"CASE WHEN size({values}) > 0 THEN {total} END", n.ty)
    if name == "total":
        return E(total, "real")
    if name == "avg":
        return E(f"CASE WHEN size({values}) > 0 THEN {total} / size({values}) END", "real")
    if name in ("min", "max"):
        return E(f"array_{name}({values})", n.ty)
    if name in ("group_concat", "string_agg"):
        sep = S.text(args[1]) if len(args) > 1 else "','"
        return E(f"CASE WHEN size({values}) > 0 THEN array_join(transform({values}, x -> CAST(x AS STRING)), {sep}) END", "text")
    raise SqlError(f"{name}() does not take EXCLUDE here")
