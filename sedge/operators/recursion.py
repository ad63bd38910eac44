"""Recursive WITH: Spark's own recursion for one UNION ALL step, else a fix point over frontiers, each a written table."""

from __future__ import annotations

from dataclasses import replace

from sedge.functions import scalar as S
from sedge.functions.scalar import E
from sedge.sql.lexer import SqlError
from sedge.sql.lower import Column, Lowering, Rel
from sedge.sql.parser import N

#: Levels of a recursion at most, on either path; rows are not bounded.
LEVELS = 100_000


def recursive(low: Lowering, state) -> Rel:
    """The relation of a CTE that names itself."""
    q, name = state.cte.query, state.cte.name.lower()
    flags = [low.mentions(c, name) > 0 for c in q.cores]
    if all(flags) or not flags.count(True):
        raise SqlError(f"circular reference: {state.cte.name}")
    first = flags.index(True)
    if not all(flags[first:]) or first == 0:
        raise SqlError("recursive terms must follow the others")
    steps, ops = q.cores[first:], q.ops[first - 1 :]
    if len(set(ops)) > 1 or ops[0] not in ("union", "union all"):
        raise SqlError("recursive terms must be joined by one kind of UNION")
    for s in steps:
        if low.mentions(s.source, name) != 1 or low.mentions(s, name) != 1:
            raise SqlError(f"multiple or indirect references to recursive table: {state.cte.name}")
        if s.group or low.has_aggregate(s.columns) or s.having is not None:
            raise SqlError("recursive aggregate queries not supported")
    anchor = N("select", ctes=q.ctes, cores=q.cores[:first], ops=q.ops[: first - 1], order=[], limit=None, offset=None)
    base = low.query(anchor, state.outer)
    names = state.cte.columns or [c.label for c in base.columns]
    if len(names) != len(base.columns):
        raise SqlError(f"table {state.cte.name} has {len(base.columns)} values for {len(names)} columns")
    columns = widened(low, state, base, steps, names)
    limit = low.limits(q)
    if isinstance(limit, tuple):
        raise SqlError("LIMIT and OFFSET of a recursive term are at most 2147483647")
    order = low.compound_order(q, Rel(base.sql, columns)) if q.order and limit else []
    if ops[0] == "union all" and len(steps) == 1 and not steps[0].distinct:
        rel = native(low, state, base, steps[0], columns, names)
    else:
        rel = fix_point(low, state, base, steps, columns, names, ops[0] == "union")
    if limit:
        by = f" ORDER BY {', '.join(order)}" if order else ""
        rel = Rel(f"SELECT * FROM ({rel.sql}) {low.fresh()}{by}{limit}", rel.columns)
    return rel


def step_rel(low: Lowering, state, step, body: str, columns: list[Column], names: list[str]) -> Rel:
    """A recursive term over `body`, the rows of the working table."""
    key = state.cte.name.lower()
    rel = Rel(body, [replace(c, label=n) for c, n in zip(columns, names)])
    low.ctes.append({key: N("cte_state", cte=state.cte, scope=list(low.ctes), rel=rel, busy=False, outer=None)})
    try:
        return low.core(step, state.outer, [])
    finally:
        low.ctes.pop()


def widened(low, state, base, steps, names) -> list[Column]:
    """Types of the whole: an anchor's NULL or integer may meet other types in a step."""
    columns = [replace(c, narrow=False) for c in base.columns]
    for _ in range(2):
        for s in steps:
            got = step_rel(low, state, s, "SELECT 1", columns, names).columns
            if len(got) != len(columns):
                raise SqlError("SELECTs to the left and right of UNION do not have the same number of result columns")
            columns = [replace(c, ty=S.common([E("", c.ty), E("", g.ty)])) for c, g in zip(columns, got)]
    return columns


def aligned(low, rel: Rel, columns: list[Column]) -> str:
    q = low.fresh()
    kinds = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "null": "STRING", "ts": "TIMESTAMP", "cell": S.CELL}
    cells = ", ".join(f"CAST({S.as_type(E(f'{q}.c{i}', p.ty, narrow=p.narrow), c.ty)} AS {kinds[c.ty]}) AS c{i}" for i, (p, c) in enumerate(zip(rel.columns, columns)))
    return f"SELECT {cells} FROM ({rel.sql}) {q}"


def native(low, state, base, step, columns, names) -> Rel:
    name = low.fresh("rec")
    body = step_rel(low, state, step, f"SELECT * FROM {name}", columns, names)
    cols = ", ".join(f"c{i}" for i in range(len(columns)))
    low.catalog.spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    low.heads.append(f"{name}({cols}) MAX RECURSION LEVEL {LEVELS} AS ({aligned(low, base, columns)} UNION ALL {aligned(low, body, columns)})")
    return Rel(f"SELECT * FROM {name}", columns)


def fix_point(low, state, base, steps, columns, names, distinct: bool) -> Rel:
    """Steps whole frontiers until one is empty; UNION drops rows already seen by a null-safe anti join."""
    from sedge.sources.scratch import written

    spark = low.catalog.spark
    head = f"WITH {', '.join(low.heads)} " if low.heads else ""
    keys = [S.key(E(f"c{i}", c.ty, coll=c.coll)) for i, c in enumerate(columns)]

    def unique(sql: str) -> str:
        if not distinct:
            return sql
        if all(k == f"c{i}" for i, k in enumerate(keys)):
            return f"SELECT DISTINCT * FROM ({sql}) {low.fresh()}"
        q = low.fresh()
        row = ", ".join(f"c{i}" for i in range(len(columns)))
        return f"SELECT {', '.join(f'{q}.r.c{i} AS c{i}' for i in range(len(columns)))} FROM (SELECT first(struct({row})) AS r FROM ({sql}) {low.fresh()} GROUP BY {', '.join(keys)}) {q}"

    seen = written(spark.sql(head + unique(aligned(low, base, columns))), "recursion")
    frontier = seen
    for _ in range(LEVELS):
        if frontier.isEmpty():
            break
        work = low.fresh("sedge_frontier_")
        frontier.createOrReplaceTempView(work)
        parts = [aligned(low, step_rel(low, state, s, f"SELECT * FROM {work}", columns, names), columns) for s in steps]
        new = unique(" UNION ALL ".join(f"({p})" if i else f"SELECT * FROM ({p})" for i, p in enumerate(parts)))
        if distinct:
            past, a, b = low.fresh("sedge_seen_"), low.fresh(), low.fresh()
            seen.createOrReplaceTempView(past)
            on = " AND ".join(f"{S.key(E(f'{a}.c{i}', c.ty, coll=c.coll))} <=> {S.key(E(f'{b}.c{i}', c.ty, coll=c.coll))}" for i, c in enumerate(columns))
            new = f"SELECT {a}.* FROM ({new}) {a} LEFT ANTI JOIN {past} {b} ON {on}"
        frontier = written(spark.sql(head + new), "recursion")
        seen = seen.union(frontier)
    else:
        raise SqlError("the recursion did not end")
    name = low.fresh("sedge_recursive_")
    seen.createOrReplaceTempView(name)
    return Rel(f"SELECT * FROM {name}", columns)
