"""Panel formulas: parsed once, planned by layout, emitted as Spark windows or as SQL.

A formula is written in ordinary arithmetic over the columns of a dense panel
``(code, date, ord, ...)``::

    -corr(rank(open), rank(volume), 10)

Operators fall in three layouts: elementwise, along a code's dates (``ts``) and across
the codes of a date (``cs``).  Equal sub-formulas, also of different formulas, are one
node.  Nodes are emitted in rounds: everything that is ready in the current layout
becomes columns of one ``select``; then the layout changes.  So any number of formulas
together needs one shuffle per change of layout and not one per operator.

Missing is NULL.  A division by zero or ``ln(0)`` gives an infinity as floating point
does; NaN becomes NULL wherever it is compared, ranked or aggregated.  Expressions don't
depend on the session's ANSI setting.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals to which values are rounded before they are ranked or compared, so that float noise can't break ties.
RANK_DECIMALS = 9


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple[Node | float | str, ...] = ()

    def inputs(self) -> list[Node]:
        return [a for a in self.args if isinstance(a, Node)]


_BIN = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "pow"}
_CMP = {ast.Lt: "<", ast.Gt: ">", ast.LtE: "<=", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
#: Along a code's dates.
TS = frozenset("sum mean prod std var tmin tmax targmin targmax trank decay corr cov delay delta ffill cummax cumsum count lead slope cov_pop cumprod1 acount".split())
#: Across the codes of a date.
CS = frozenset("rank rankd scale indn csum cmean cstd cmedian ccount cmin cmax order orderd cpct rank_avg cstds".split())
LOGICAL = frozenset("< > <= >= == != or and not isnull".split())


def parse(text: str) -> Node:
    """A formula as a tree.  ``^`` is power; ``if(c, a, b)`` takes ``b`` where ``c`` isn't true."""
    return _build(ast.parse(text.replace("^", "**").replace("if(", "iff("), mode="eval").body)


def _build(e: ast.AST) -> Node:
    if isinstance(e, ast.Constant):
        return Node("const", (float(e.value) if not isinstance(e.value, str) else e.value,))
    if isinstance(e, ast.Name):
        if e.id.startswith("adv") and e.id[3:].isdigit():
            return Node("mean", (Node("field", ("amount",)), float(e.id[3:])))
        return Node("field", (e.id,))
    if isinstance(e, ast.UnaryOp):
        inner = _build(e.operand)
        if isinstance(e.op, ast.Not):
            return Node("not", (inner,))
        if inner.op == "const":
            return Node("const", (-inner.args[0],)) if isinstance(e.op, ast.USub) else inner
        return Node("neg", (inner,)) if isinstance(e.op, ast.USub) else inner
    if isinstance(e, ast.BinOp):
        return Node(_BIN[type(e.op)], (_build(e.left), _build(e.right)))
    if isinstance(e, ast.Compare):
        return Node(_CMP[type(e.ops[0])], (_build(e.left), _build(e.comparators[0])))
    if isinstance(e, ast.BoolOp):
        op = "or" if isinstance(e.op, ast.Or) else "and"
        out = _build(e.values[0])
        for v in e.values[1:]:
            out = Node(op, (out, _build(v)))
        return out
    if isinstance(e, ast.Call):
        name = e.func.id
        args = [_build(a) for a in e.args]
        if name in TS | CS:
            fixed = {"corr": 2, "cov": 2, "slope": 2, "cov_pop": 2}.get(name, 1)
            return Node(name, tuple(args[:fixed]) + tuple(a.args[0] for a in args[fixed:]))
        return Node(name, tuple(args))
    raise ValueError(f"not a formula: {ast.dump(e)}")


def windows_of(node: Node) -> int:
    """Rows of history before the first value: an upper bound from the window lengths."""
    own = 0
    if node.op in TS:
        numbers = [a for a in node.args if isinstance(a, float)]
        if node.op in ("delay", "delta"):
            own = int(numbers[0])
        elif numbers:
            own = int(numbers[0]) - 1
    return own + max((windows_of(n) for n in node.inputs()), default=0)


def stages(roots: Iterable[Node]) -> list[tuple[str, list[Node]]]:
    """Rounds of (layout, nodes), such that each round only needs rounds before it."""
    nodes: dict[Node, set[Node]] = {}

    @lru_cache(None)
    def below(n: Node) -> frozenset[Node]:
        """Window nodes that ``n`` needs, itself included."""
        needs = frozenset().union(*(below(c) for c in n.inputs())) if n.inputs() else frozenset()
        if n.op in TS or n.op in CS:
            nodes[n] = set(needs)
            return needs | {n}
        return needs

    for r in roots:
        below(r)
    rounds: list[tuple[str, list[Node]]] = []
    done: set[Node] = set()
    layout = "ts"
    idle = 0
    while len(done) < len(nodes):
        ready = [n for n, needs in nodes.items() if n not in done and needs <= done and (n.op in TS) == (layout == "ts")]
        if ready:
            rounds.append((layout, ready))
            done |= set(ready)
            idle = 0
        else:
            layout = "cs" if layout == "ts" else "ts"
            idle += 1
            if idle > 2:
                raise RuntimeError("formulas can't be scheduled")
    return rounds


def shared_levels(roots: Iterable[Node]) -> Callable[[Iterable[Node], dict[Node, str]], list[list[Node]]]:
    """Which elementwise nodes, used more than once, should become columns before the given nodes are built; level by level."""
    uses: dict[Node, int] = {}
    seen: set[Node] = set()

    def count(n: Node) -> None:
        uses[n] = uses.get(n, 0) + 1
        if n not in seen:
            seen.add(n)
            for c in n.inputs():
                count(c)

    for r in roots:
        count(r)
    plain = ("field", "const", "neg", "null")

    def plan(nodes: Iterable[Node], known: dict[Node, str]) -> list[list[Node]]:
        level: dict[Node, int] = {}

        def visit(n: Node) -> int:
            if n in known or n.op in plain[:2]:
                return 0
            if n not in level:
                deep = max((visit(c) for c in n.inputs()), default=0)
                level[n] = deep + (uses.get(n, 0) > 1 and n.op not in plain)
            return level[n]

        top = max((visit(n) for n in nodes), default=0)
        return [[n for n, k in level.items() if k == i and uses.get(n, 0) > 1 and n.op not in plain] for i in range(1, top + 1)]

    return plan


def exchanges(roots: Iterable[Node]) -> int:
    """How many times the layout is set up, the first included."""
    out, last = 0, None
    for layout, _ in stages(roots):
        out += layout != last
        last = layout
    return max(1, out)


# --- Spark ---------------------------------------------------------------------------


def clear(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).when((b == 0) & (a > 0), F.lit(math.inf)).when((b == 0) & (a < 0), F.lit(-math.inf))


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf))


def pct_rank(x: Column, w_order, w_all) -> Column:
    """Average rank over the number of values; NULL stays NULL."""
    least, most = F.rank().over(w_order), F.count(x).over(w_order.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(x.isNotNull(), (least + most) / 2.0 / F.count(x).over(w_all))


class _Spark:
    def __init__(self) -> None:
        self.known: dict[Node, str] = {}

    def elementwise(self, n: Node) -> Column:
        if n in self.known:
            return F.col(self.known[n])
        a = [self.elementwise(x) if isinstance(x, Node) else x for x in n.args]
        op = n.op
        if op == "field":
            return F.col(n.args[0])
        if op == "const":
            return F.lit(n.args[0])
        if op in ("+", "-", "*"):
            return {"+": a[0].__add__, "-": a[0].__sub__, "*": a[0].__mul__}[op](a[1])
        if op == "/":
            return safe_div(a[0], a[1])
        if op == "pow":
            # As floating point has it: one to any power, and anything to the power of zero, are one, missing or not.
            return F.pow(a[0], a[1]) if n.args[1].op == "const" else F.when((a[0] == 1) | (a[1] == 0), F.lit(1.0)).otherwise(F.pow(a[0], a[1]))
        if op == "neg":
            return -a[0]
        if op in ("<", ">", "<=", ">=", "==", "!="):
            x, y = (v if m.op == "const" else F.round(clear(v), RANK_DECIMALS) for v, m in zip(a, n.args, strict=True))
            return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "==": x == y, "!=": x != y}[op]
        yes = lambda c: F.coalesce(c, F.lit(False))
        simple: dict[str, Callable[[], Column]] = {
            "or": lambda: yes(a[0]) | yes(a[1]), "and": lambda: yes(a[0]) & yes(a[1]), "not": lambda: ~yes(a[0]),
            "isnull": lambda: clear(a[0]).isNull(),
            "iff": lambda: F.when(yes(a[0]), a[1]).otherwise(a[2]), "b2f": lambda: yes(a[0]).cast("double"),
            "abs": lambda: F.abs(a[0]), "ln": lambda: safe_ln(clear(a[0])), "sgn": lambda: F.signum(a[0]), "sqrt": lambda: F.sqrt(a[0]), "exp": lambda: F.exp(a[0]),
            "spow": lambda: F.signum(a[0]) * F.pow(F.abs(a[0]), a[1]), "coalesce": lambda: F.coalesce(*[clear(x) for x in a]),
            "min2": lambda: F.when(clear(a[0]).isNotNull() & clear(a[1]).isNotNull(), F.least(a[0], a[1])),
            "max2": lambda: F.when(clear(a[0]).isNotNull() & clear(a[1]).isNotNull(), F.greatest(a[0], a[1])),
            "finite": lambda: finite(clear(a[0])), "mod": lambda: a[0] % a[1], "round": lambda: F.round(a[0], int(n.args[1].args[0])), "ceil": lambda: F.ceil(a[0]).cast("double"),
            "null": lambda: F.lit(None).cast("double"), "nz": lambda: F.when(a[0] != 0, a[0]), "floor": lambda: F.floor(a[0]).cast("double"),
        }
        return simple[op]()

    def window(self, n: Node, x: list[Column]) -> Column:
        op = n.op
        p = [v for v in n.args if not isinstance(v, Node)]
        by_code = Window.partitionBy("code").orderBy("date")
        if op in TS:
            d = math.floor(p[0]) if p else 0
            m = math.floor(p[1]) if len(p) > 1 else d
            w = by_code.rowsBetween(-(d - 1), 0)
            if op == "delay":
                return F.lag(x[0], d).over(by_code) if d else x[0]
            if op == "lead":
                return F.lead(x[0], d).over(by_code)
            if op == "delta":
                return x[0] - F.lag(x[0], d).over(by_code)
            if op == "ffill":
                return F.last(x[0], ignorenulls=True).over(by_code.rowsBetween(Window.unboundedPreceding, 0))
            if op == "cummax":
                return F.when(x[0].isNotNull(), F.max(x[0]).over(by_code.rowsBetween(Window.unboundedPreceding, 0)))
            if op == "cumsum":
                return F.coalesce(F.sum(x[0]).over(by_code.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
            if op == "decay":
                total = d * (d + 1) / 2
                out = x[0] * F.lit(d / total)
                for k in range(1, d):
                    out = out + F.lag(x[0], k).over(by_code) * F.lit((d - k) / total)
                return out
            whole = lambda c, v: F.when(F.count(v).over(w) >= m, c)
            if op in ("trank", "targmin", "targmax", "prod"):
                if op == "prod":
                    return whole(F.product(x[0]).over(w), x[0])
                r = F.round(x[0], RANK_DECIMALS)
                seen = F.collect_list(r).over(w)
                if op == "trank":
                    less = F.size(F.filter(seen, lambda v: v < r))
                    same = F.size(F.filter(seen, lambda v: v == r))
                    return whole((less + (same + 1) / 2.0) / float(d), x[0])
                edge = F.min(r).over(w) if op == "targmin" else F.max(r).over(w)
                return whole((F.array_position(seen, edge) - 1).cast("double"), x[0])
            v = [finite(c) for c in x]
            if op in ("corr", "cov", "slope", "cov_pop"):
                both = F.when(v[0].isNotNull() & v[1].isNotNull(), F.lit(1))
                if op == "corr":
                    spread = F.stddev_pop(v[0]).over(w) * F.stddev_pop(v[1]).over(w)
                    out = F.when(spread > 0, F.try_divide(F.covar_pop(v[0], v[1]).over(w), spread))
                elif op == "slope":
                    out = F.when(F.var_pop(v[1]).over(w) > 0, F.try_divide(F.covar_pop(v[0], v[1]).over(w), F.var_pop(v[1]).over(w)))
                else:
                    out = (F.covar_samp if op == "cov" else F.covar_pop)(v[0], v[1]).over(w)
                return whole(out, both)
            plain = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "tmin": F.min, "tmax": F.max, "count": F.count}[op]
            out = plain(v[0]).over(w)
            return out.cast("double") if op == "count" else whole(out, v[0])
        by_date = Window.partitionBy("date")
        if op in ("rank", "rank_avg", "rankd"):
            r = F.round(x[0], RANK_DECIMALS)
            order = by_date.orderBy(r.desc_nulls_last() if op == "rankd" else r.asc_nulls_last())
            out = pct_rank(r, order, by_date)
            return out if op == "rank" else out * F.count(r).over(by_date)
        if op in ("order", "orderd"):
            r = F.round(x[0], RANK_DECIMALS)
            return F.when(x[0].isNotNull(), F.row_number().over(by_date.orderBy(r.desc_nulls_last() if op == "orderd" else r.asc_nulls_last(), "code"))).cast("double")
        if op == "scale":
            return x[0] * F.lit(p[0] if p else 1.0) / nz(F.sum(F.abs(x[0])).over(by_date))
        if op == "indn":
            return x[0] - F.avg(x[0]).over(Window.partitionBy("date", "ind"))
        if op == "cpct":
            return F.percentile(x[0], F.lit(p[0])).over(by_date)
        if op == "cmedian":
            return F.median(x[0]).over(by_date)
        f = {"csum": F.sum, "cmean": F.avg, "cstd": F.stddev_pop, "cstds": F.stddev_samp, "ccount": F.count, "cmin": F.min, "cmax": F.max}[op]
        out = f(x[0]).over(by_date)
        return out.cast("double") if op == "ccount" else out


def nz(x: Column) -> Column:
    return F.when(x != 0, x)


def _logical(n: Node) -> bool:
    return n.op in LOGICAL


#: Operators of one layout between two calls of ``settle``; each across a date is a sort of its own.
SETTLED_NODES = 60


def evaluate(panel: DataFrame, formulas: dict[str, str], keep: list[str] | None = None, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``panel`` (or its columns ``keep``) with one column for each formula.

    ``settle`` is applied whenever the layout changes, and after ``SETTLED_NODES`` operators
    of one layout, to the columns that are still needed; a table written there keeps the plan
    of very many formulas short enough for a task.
    """
    roots = {name: parse(text) for name, text in formulas.items()}
    s, df, before = _Spark(), panel, shared_levels(roots.values())

    def share(df: DataFrame, nodes: Iterable[Node]) -> DataFrame:
        for level in before(nodes, s.known):
            names = {n: f"__e{len(s.known) + i}" for i, n in enumerate(level)}
            df = df.select("*", *[s.elementwise(n).alias(c) for n, c in names.items()])
            s.known |= names
        return df

    rounds, last, since = stages(roots.values()), None, 0
    if settle:
        rounds = [(layout, nodes[k : k + SETTLED_NODES]) for layout, nodes in rounds for k in range(0, len(nodes), SETTLED_NODES)]
    for at, (layout, nodes) in enumerate(rounds):
        since += len(nodes)
        if settle and last is not None and (last != layout or since > SETTLED_NODES):
            df, since = settle(df.select(*_needed([n for _, later in rounds[at:] for n in later], roots.values(), s.known, keep or panel.columns))), len(nodes)
        last = layout
        df = share(df, [i for n in nodes for i in n.inputs()])
        inputs: dict[Node, str] = {}
        for n in nodes:
            for i in n.inputs():
                if i not in inputs and i not in s.known:
                    inputs[i] = f"__i{len(s.known)}_{len(inputs)}"
        df = df.select("*", *[clear(s.elementwise(i).cast("double")).alias(c) for i, c in inputs.items()])
        fields = [(n, [F.col(inputs.get(i) or s.known[i]) for i in n.inputs()]) for n in nodes]
        added = {n: f"__n{len(s.known) + k}" for k, n in enumerate(nodes)}
        df = df.select("*", *[clear(s.window(n, x).cast("double")).alias(added[n]) for n, x in fields])
        s.known |= added
    df = share(df, roots.values())
    return df.select(*(keep or panel.columns), *[(clear(c.cast("double")) if not _logical(r) else F.coalesce(c, F.lit(False))).alias(name) for name, r in roots.items() for c in [s.elementwise(r)]])


def _needed(later: Iterable[Node], roots: Iterable[Node], known: dict[Node, str], keep: list[str]) -> list[str]:
    """Columns that the nodes still to come, and the results, are made of."""
    out = dict.fromkeys([*keep, "code", "date"])
    seen: set[Node] = set()

    def visit(n: Node, itself: bool = True) -> None:
        if itself and n in known:
            out[known[n]] = None
        elif n.op == "field":
            out[n.args[0]] = None
        elif n not in seen:
            seen.add(n)
            for c in n.inputs():
                visit(c)
            if n.op == "indn":
                out["ind"] = None

    for n in [*later, *roots]:
        visit(n)
    return list(out)


# --- SQL -----------------------------------------------------------------------------


def _sql_num(v: float) -> str:
    return f"({v!r})::double"


class _Sql:
    def __init__(self) -> None:
        self.known: dict[Node, str] = {}

    def clear(self, x: str) -> str:
        return f"(case when not isnan({x}) then {x} end)"

    def elementwise(self, n: Node) -> str:
        if n in self.known:
            return self.known[n]
        a = [self.elementwise(x) if isinstance(x, Node) else x for x in n.args]
        op = n.op
        if op == "field":
            return n.args[0]
        if op == "const":
            return _sql_num(n.args[0]) if isinstance(n.args[0], float) else f"'{n.args[0]}'"
        if op in ("+", "-", "*"):
            return f"({a[0]} {op} {a[1]})"
        if op == "/":
            return f"(case when {a[1]} <> 0 then {a[0]} / {a[1]} when {a[1]} = 0 and {a[0]} > 0 then 'inf'::double when {a[1]} = 0 and {a[0]} < 0 then '-inf'::double end)"
        if op == "neg":
            return f"(-{a[0]})"
        if op in ("<", ">", "<=", ">=", "==", "!="):
            x, y = (v if m.op == "const" else f"round({self.clear(v)}, {RANK_DECIMALS})" for v, m in zip(a, n.args, strict=True))
            return f"({x} {'=' if op == '==' else op} {y})"
        yes = lambda c: f"coalesce({c}, false)"
        if op in ("or", "and"):
            return f"({yes(a[0])} {op} {yes(a[1])})"
        return {
            "pow": lambda: f"pow({a[0]}, {a[1]})" if n.args[1].op == "const" else f"(case when {a[0]} = 1 or {a[1]} = 0 then 1.0::double else pow({a[0]}, {a[1]}) end)", "not": lambda: f"(not {yes(a[0])})", "isnull": lambda: f"({self.clear(a[0])} is null)",
            "iff": lambda: f"(case when {yes(a[0])} then {a[1]} else {a[2]} end)", "b2f": lambda: f"({yes(a[0])}::int::double)",
            "abs": lambda: f"abs({a[0]})", "ln": lambda: f"(case when {self.clear(a[0])} > 0 then ln({a[0]}) when {a[0]} = 0 then '-inf'::double end)",
            "sgn": lambda: f"(sign({a[0]})::double)", "sqrt": lambda: f"(case when {a[0]} >= 0 then sqrt({a[0]}) end)", "exp": lambda: f"exp({a[0]})",
            "spow": lambda: f"(sign({a[0]}) * pow(abs({a[0]}), {a[1]}))", "coalesce": lambda: f"coalesce({', '.join(map(self.clear, a))})",
            "min2": lambda: f"(case when {self.clear(a[0])} is not null and {self.clear(a[1])} is not null then least({a[0]}, {a[1]}) end)",
            "max2": lambda: f"(case when {self.clear(a[0])} is not null and {self.clear(a[1])} is not null then greatest({a[0]}, {a[1]}) end)",
            "finite": lambda: f"(case when isfinite({a[0]}) then {a[0]} end)", "mod": lambda: f"(({a[0]})::bigint % ({a[1]})::bigint)::double", "round": lambda: f"round({a[0]}, {int(n.args[1].args[0])})",
            "ceil": lambda: f"ceil({a[0]})", "floor": lambda: f"floor({a[0]})", "null": lambda: "(null::double)", "nz": lambda: f"nullif({a[0]}, 0)",
        }[op]()

    def window(self, n: Node, x: list[str]) -> str:
        op = n.op
        p = [v for v in n.args if not isinstance(v, Node)]
        over = "over (partition by code order by date)"
        if op in TS:
            d = math.floor(p[0]) if p else 0
            m = math.floor(p[1]) if len(p) > 1 else d
            w = f"over (partition by code order by date rows between {d - 1} preceding and current row)"
            so_far = "over (partition by code order by date rows between unbounded preceding and current row)"
            if op in ("delay", "lead"):
                return f"{'lag' if op == 'delay' else 'lead'}({x[0]}, {d}) {over}"
            if op == "delta":
                return f"{x[0]} - lag({x[0]}, {d}) {over}"
            if op == "ffill":
                return f"last_value({x[0]} ignore nulls) {so_far}"
            if op == "cummax":
                return f"case when {x[0]} is not null then max({x[0]}) {so_far} end"
            if op == "cumsum":
                return f"coalesce(sum({x[0]}) {so_far}, 0)"
            if op == "decay":
                total = d * (d + 1) / 2
                return " + ".join(f"{x[0] if not k else f'lag({x[0]}, {k}) {over}'} * {_sql_num((d - k) / total)}" for k in range(d))
            whole = lambda c, v: f"case when count({v}) {w} >= {m} then {c} end"
            if op == "prod":
                return whole(f"product({x[0]}) {w}", x[0])
            if op == "trank":
                r = f"round({x[0]}, {RANK_DECIMALS})"
                seen = f"(list({r}) {w})"
                return whole(f"(len(list_filter({seen}, lambda v: v < {r})) + (len(list_filter({seen}, lambda v: v = {r})) + 1) / 2.0) / {float(d)}", x[0])
            if op in ("targmin", "targmax"):
                r = f"round({x[0]}, {RANK_DECIMALS})"
                return whole(f"list_position(list({r}) {w}, {'min' if op == 'targmin' else 'max'}({r}) {w}) - 1", x[0])
            v = [f"(case when isfinite({c}) then {c} end)" for c in x]
            if op in ("corr", "cov", "slope", "cov_pop"):
                both = f"(case when {v[0]} is not null and {v[1]} is not null then 1 end)"
                if op == "corr":
                    spread = f"(stddev_pop({v[0]}) {w} * stddev_pop({v[1]}) {w})"
                    return whole(f"case when {spread} > 0 then covar_pop({v[0]}, {v[1]}) {w} / {spread} end", both)
                if op == "slope":
                    return whole(f"case when var_pop({v[1]}) {w} > 0 then covar_pop({v[0]}, {v[1]}) {w} / var_pop({v[1]}) {w} end", both)
                return whole(f"{'covar_samp' if op == 'cov' else 'covar_pop'}({v[0]}, {v[1]}) {w}", both)
            f = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "var": "var_samp", "tmin": "min", "tmax": "max", "count": "count"}[op]
            return f"{f}({v[0]}) {w}" if op == "count" else whole(f"{f}({v[0]}) {w}", v[0])
        by = "over (partition by date)"
        r = f"round({x[0]}, {RANK_DECIMALS})"
        if op in ("rank", "rank_avg", "rankd"):
            way = "desc" if op == "rankd" else "asc"
            average = f"(rank() over (partition by date order by {r} {way} nulls last) + (count(*) over (partition by date, {r}) - 1) / 2.0)"
            return f"case when {x[0]} is not null then {average}" + (f" / count({x[0]}) {by}" if op == "rank" else "") + " end"
        if op in ("order", "orderd"):
            return f"case when {x[0]} is not null then row_number() over (partition by date order by {r} {'desc' if op == 'orderd' else 'asc'} nulls last, code) end"
        if op == "scale":
            return f"{x[0]} * {_sql_num(p[0] if p else 1.0)} / nullif(sum(abs({x[0]})) {by}, 0)"
        if op == "indn":
            return f"{x[0]} - avg({x[0]}) over (partition by date, ind)"
        if op == "cpct":
            return f"quantile_cont({x[0]}, {p[0]}) {by}"
        f = {"csum": "sum", "cmean": "avg", "cstd": "stddev_pop", "cstds": "stddev_samp", "ccount": "count", "cmin": "min", "cmax": "max", "cmedian": "median"}[op]
        return f"{f}({x[0]}) {by}"


def to_sql(panel: str, formulas: dict[str, str], keep: str = "code, date") -> str:
    """CTEs (without ``with``) ending in ``result``, over the CTE or table ``panel``."""
    roots = {name: parse(text) for name, text in formulas.items()}
    s, ctes, last, k, before = _Sql(), [], panel, 0, shared_levels(roots.values())

    def share(nodes: Iterable[Node]) -> None:
        nonlocal last, k
        for level in before(nodes, s.known):
            names = {n: f"e{len(s.known) + i}" for i, n in enumerate(level)}
            ctes.append(f"{panel}_{k} as (select *, {', '.join(f'{s.elementwise(n)} as {c}' for n, c in names.items())} from {last})")
            last, k = f"{panel}_{k}", k + 1
            s.known |= names

    for _, nodes in stages(roots.values()):
        share([i for n in nodes for i in n.inputs()])
        inputs: dict[Node, str] = {}
        for n in nodes:
            for i in n.inputs():
                if i not in inputs and i not in s.known:
                    inputs[i] = f"i{len(s.known)}_{len(inputs)}"
        if inputs:
            cols = ", ".join(f"{s.clear(f'({s.elementwise(i)})::double')} as {c}" for i, c in inputs.items())
            ctes.append(f"{panel}_{k} as (select *, {cols} from {last})")
            last, k = f"{panel}_{k}", k + 1
        added = {n: f"n{len(s.known) + j}" for j, n in enumerate(nodes)}
        cols = ", ".join(f"{s.window(n, [inputs.get(i) or s.known[i] for i in n.inputs()])} as {added[n]}" for n in nodes)
        ctes.append(f"{panel}_{k} as (select *, {cols} from {last})")
        ctes.append(f"{panel}_{k + 1} as (select * replace ({', '.join(f'({s.clear(f"{c}::double")}) as {c}' for c in added.values())}) from {panel}_{k})")
        last, k = f"{panel}_{k + 1}", k + 2
        s.known |= added
    share(roots.values())
    outs = ", ".join((s.clear(f"({s.elementwise(r)})::double") if not _logical(r) else f"coalesce({s.elementwise(r)}, false)") + f" as {name}" for name, r in roots.items())
    ctes.append(f"result as (select {keep}, {outs} from {last})")
    return ",\n".join(ctes)
