"""Aggregate calls: DISTINCT, FILTER, input ORDER BY and the dialect's own totals and lists."""

from __future__ import annotations

from sedge.functions import scalar as S
from sedge.functions.scalar import E
from sedge.sql.lexer import SqlError


def aggregate(low, e, scope, rowid: str | None) -> E:
    name, args = e.name, [low.expr(a, scope) for a in e.args]
    if any(a.items for a in args):
        raise SqlError("row value misused")
    if e.distinct and len(args) != 1:
        raise SqlError("DISTINCT aggregates must have exactly one argument")
    cond = S.truth(low.expr(e.filter, scope)) if e.filter is not None else None
    distinct = "DISTINCT " if e.distinct else ""

    def kept(sql: str) -> str:
        """The filter inside the argument: it holds for every kind of aggregate."""
        return f"CASE WHEN {cond} THEN {sql} END" if cond else sql

    made = lambda sql, ty, **k: E(sql, ty, agg=True, **k)
    if name == "count":
        if not args:
            return made(f"count({kept('1')})", "int")
        return made(f"count({distinct}{kept(S.key(args[0]) if e.distinct else S.out(args[0]))})", "int")
    if len(args) < 1:
        raise SqlError(f"wrong number of arguments to function {name}()")
    if name in ("sum", "total", "avg"):
        n = S.numeric(args[0])
        x = S.real(n) if name != "sum" else n.sql
        if name == "sum":
            return made(f"sum({distinct}{kept(x)})", n.ty)
        if name == "avg":
            return made(f"avg({distinct}{kept(x)})", "real")
        return made(f"coalesce(sum({distinct}{kept(x)}), 0D)", "real")
    if name in ("min", "max"):
        a = args[0]
        v = S.out(a)
        if a.ty == "text" and a.coll not in (None, "BINARY"):
            tie = f"struct({S.key(a)}, {('-' if name == 'max' else '') + rowid})" if rowid and not rowid.startswith("struct") else S.key(a)
            return made(f"{name}_by({a.sql}, CASE WHEN {a.sql} IS NOT NULL{f' AND {cond}' if cond else ''} THEN {tie} END)", "text", coll=a.coll)
        return made(f"{name}({kept(v)})", "int" if a.ty == "bool" else a.ty, coll=a.coll, aff=a.aff, narrow=a.narrow)
    if name in ("group_concat", "string_agg"):
        return made(_listed(low, e, args, scope, rowid, cond), "text")
    if name in ("median", "percentile_cont", "percentile"):
        if name == "percentile_cont" and e.order:
            p, x = args[0], low.expr(e.order[0].expr, scope)
        elif name == "median":
            p, x = S.literal(0.5), args[0]
        else:
            x, p = args
        if not isinstance(p.literal, (int, float)):
            raise SqlError(f"{name} needs a literal fraction")
        f = p.literal / 100 if name == "percentile" else p.literal
        return made(f"percentile({kept(S.real(x))}, {float(f)!r}D)", "real")
    if name == "json_group_array":
        order = f"struct({', '.join([*( [rowid] if rowid and not rowid.startswith('struct') else []), S.out(args[0])])})"
        items = f"array_sort(collect_list({kept(order)}))" if rowid and not rowid.startswith("struct") else f"sort_array(collect_list({kept(f'struct({S.out(args[0])} AS v)')}))"
        field = "x.col2" if rowid and not rowid.startswith("struct") else "x.v"
        return made(f"to_json(transform({items}, x -> {field}))", "text")
    if name == "json_group_object":
        return made(f"to_json(map_from_entries(array_sort(collect_list({kept(f'struct({S.text(args[0])} AS k, {S.out(args[1])} AS v)')}))))", "text")
    raise SqlError(f"no such aggregate: {name}")


def _listed(low, e, args, scope, rowid, cond) -> str:
    """Texts in input order, each after the separator of its own row but for the first; NULLs are left out.

    The rows of a group are gathered as structs of order keys, place, separator and text and sorted as such.
    """
    x = S.text(args[0])
    sep = S.text(args[1]) if len(args) > 1 else "','"
    if len(args) > 2:
        raise SqlError(f"wrong number of arguments to function {e.name}()")
    keys, flips = [], []
    for t in e.order:
        k = low.expr(t.expr, scope)
        s = S.key(k) if k.ty != "bool" else S.out(k)
        nulls_last = t.nulls == "last" or t.nulls is None and t.desc
        keys.append(f"CASE WHEN {s} IS NULL THEN {2 if nulls_last else 0} ELSE 1 END")
        flips.append(False)
        keys.append(s)
        flips.append(t.desc)
    place = rowid if rowid else None
    if place:
        keys.append(place)
        flips.append(False)
    elif not e.order:
        keys.append(x)
        flips.append(False)
    fields = [f"{k} AS k{i}" for i, k in enumerate(keys)] + [f"{sep} AS sep", f"{x} AS v"]
    test = f"{x} IS NOT NULL" + (f" AND {cond}" if cond else "")
    items = f"collect_list(CASE WHEN {test} THEN struct({', '.join(fields)}) END)"
    cmp = "0"
    for i, flip in reversed(list(enumerate(flips))):
        a, b = (1, -1) if flip else (-1, 1)
        cmp = f"CASE WHEN l.k{i} < r.k{i} THEN {a} WHEN l.k{i} > r.k{i} THEN {b} ELSE {cmp} END"
    items = f"array_sort({items}, (l, r) -> {cmp})"
    if e.distinct:
        same = S.collated("{}.v", args[0].coll)
        sole = len(e.order) == 1 and e.order[0].expr == e.args[0]
        # Equal texts stand together after a sort by key; the first (or last) of each stays, and the order before comes back.
        place = "r.i - l.i" if sole else "l.i - r.i"
        numbered = f"transform({items}, (y, i) -> struct({same.format('y')} AS k, i AS i, y AS y))"
        runs = f"array_sort({numbered}, (l, r) -> CASE WHEN l.k < r.k THEN -1 WHEN l.k > r.k THEN 1 ELSE {place} END)"
        heads = f"filter(arrays_zip({runs}, concat(array(NULL), {runs})), z -> z.`0` IS NOT NULL AND (z.`1` IS NULL OR z.`1`.k <> z.`0`.k))"
        items = f"transform(array_sort(transform({heads}, z -> struct(z.`0`.i AS i, z.`0`.y AS y)), (l, r) -> l.i - r.i), w -> w.y)"
    joined = f"array_join(transform({items}, (y, i) -> CASE WHEN i = 0 THEN y.v ELSE concat(coalesce(y.sep, ''), y.v) END), '')"
    return f"CASE WHEN count(CASE WHEN {test} THEN 1 END) > 0 THEN {joined} END"
