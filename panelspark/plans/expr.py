"""Factor expressions: small immutable trees over a panel (item_id, date, measures).

A tree says what a factor is. plan() in planner.py turns a set of them into a few DataFrame projections; sql() in the
same module writes the same tree as DuckDB SQL, which the tests run beside it. Missing is NULL, never NaN: divisions
by zero, logarithms of what is not positive and windows that are too short all give NULL.

Axes: "T" windows run along an item's dates, "X" windows across the items of a date; other nodes are row-wise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ITEM, DATE, EPS = "item_id", "date", 1e-12


@dataclass(frozen=True, eq=False)
class E:
    key: str
    args: tuple[E, ...]
    axis: str  # "", "T" or "X"
    column: Callable[..., Column] = field(repr=False)
    text: Callable[..., str] = field(repr=False)
    reach: tuple[int | None, int] = (0, 0)  # rows before and after the current one that a "T" window takes; None: all

    def __add__(self, other):
        return add(self, other)

    def __radd__(self, other):
        return add(other, self)

    def __sub__(self, other):
        return sub(self, other)

    def __rsub__(self, other):
        return sub(other, self)

    def __mul__(self, other):
        return mul(self, other)

    def __rmul__(self, other):
        return mul(other, self)

    def __truediv__(self, other):
        return div(self, other)

    def __rtruediv__(self, other):
        return div(other, self)

    def __neg__(self):
        return row("neg", lambda x: -x, lambda x: f"(-{x})", self)

    def __lt__(self, other):
        return row("lt", lambda a, b: a < b, lambda a, b: f"({a} < {b})", self, other)

    def __gt__(self, other):
        return row("gt", lambda a, b: a > b, lambda a, b: f"({a} > {b})", self, other)

    def __ge__(self, other):
        return row("ge", lambda a, b: a >= b, lambda a, b: f"({a} >= {b})", self, other)

    def __le__(self, other):
        return row("le", lambda a, b: a <= b, lambda a, b: f"({a} <= {b})", self, other)


def wrap(x) -> E:
    return x if isinstance(x, E) else lit(x)


def make(name: str, axis: str, column, text, *args, extra: tuple = (), reach: tuple[int | None, int] | None = None) -> E:
    """reach: of a "T" window; unless said, all rows before."""
    own = tuple(wrap(a) for a in args)
    return E(f"{name}({', '.join([*(a.key for a in own), *map(repr, extra)])})", own, axis, column, text, reach or ((None, 0) if axis == "T" else (0, 0)))


def row(name: str, column, text, *args) -> E:
    return make(name, "", column, text, *args)


def col(name: str) -> E:
    return E(name, (), "", lambda: F.col(name), lambda: name)


def lit(value: float | None) -> E:
    if value is None:
        return E("null", (), "", lambda: F.lit(None).cast("double"), lambda: "CAST(NULL AS DOUBLE)")
    return E(repr(float(value)), (), "", lambda: F.lit(float(value)), lambda: f"CAST({float(value)!r} AS DOUBLE)")


# Row-wise functions.


def add(a, b) -> E:
    return row("add", lambda x, y: x + y, lambda x, y: f"({x} + {y})", a, b)


def sub(a, b) -> E:
    return row("sub", lambda x, y: x - y, lambda x, y: f"({x} - {y})", a, b)


def mul(a, b) -> E:
    return row("mul", lambda x, y: x * y, lambda x, y: f"({x} * {y})", a, b)


def div(a, b) -> E:
    return row("div", lambda x, y: F.try_divide(x, y), lambda x, y: f"({x} / nullif({y}, 0))", a, b)


def ln(x) -> E:
    return row("ln", lambda v: F.when(v > 0, F.ln(v)), lambda v: f"(CASE WHEN {v} > 0 THEN ln({v}) END)", x)


def sqrt(x) -> E:
    return row("sqrt", lambda v: F.when(v >= 0, F.sqrt(v)), lambda v: f"(CASE WHEN {v} >= 0 THEN sqrt({v}) END)", x)


def absolute(x) -> E:
    return row("abs", F.abs, lambda v: f"abs({v})", x)


def sign(x) -> E:
    return row("sign", F.signum, lambda v: f"CAST(sign({v}) AS DOUBLE)", x)


def top(*xs) -> E:
    """Greatest that is there: NULLs are passed over."""
    return row("greatest", F.greatest, lambda *v: f"greatest({', '.join(v)})", *xs)


def bottom(*xs) -> E:
    return row("least", F.least, lambda *v: f"least({', '.join(v)})", *xs)


def clip(x, low: float | None = None, high: float | None = None) -> E:
    """NULL stays NULL."""
    out = wrap(x)
    if low is not None:
        out = when(out < low, low, out)
    if high is not None:
        out = when(out > high, high, out)
    return out


def nonzero(x, eps: float = EPS) -> E:
    """x where it is further from 0 than eps."""
    return row("nonzero", lambda v: F.when(F.abs(v) > eps, v), lambda v: f"(CASE WHEN abs({v}) > {eps!r} THEN {v} END)", x)


def when(cond: E, yes, no) -> E:
    """A NULL condition takes `no`."""
    return row("when", lambda c, a, b: F.when(c, a).otherwise(b), lambda c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)", cond, yes, no)


def given(x, then) -> E:
    """`then` where x is not NULL."""
    return row("given", lambda v, t: F.when(v.isNotNull(), t), lambda v, t: f"(CASE WHEN {v} IS NOT NULL THEN {t} END)", x, then)


def fill(x, value) -> E:
    return row("fill", lambda v, d: F.coalesce(v, d), lambda v, d: f"coalesce({v}, {d})", x, value)


def rounded(x, digits: int = 10) -> E:
    """Fixes a value that ranks or signs are taken of, so that they do not follow the last bit of a sum."""
    return make("round", "", lambda v: F.round(v, digits), lambda v: f"round({v}, {digits})", x, extra=(digits,))


# Windows along an item's dates.


def _t():
    """Made when a plan is: a window needs a session, a tree does not."""
    return Window.partitionBy(ITEM).orderBy(DATE)


def _x():
    return Window.partitionBy(DATE)


_T_SQL = f"PARTITION BY {ITEM} ORDER BY {DATE}"


def _frame(n: int):
    return lambda: _t().rowsBetween(-(n - 1), 0), f"({_T_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x, k: int = 1) -> E:
    return make("lag", "T", lambda v: F.lag(v, k).over(_t()), lambda v: f"lag({v}, {k}) OVER ({_T_SQL})", x, extra=(k,), reach=(max(k, 0), max(-k, 0)))


def lead(x, k: int = 1) -> E:
    return make("lead", "T", lambda v: F.lead(v, k).over(_t()), lambda v: f"lead({v}, {k}) OVER ({_T_SQL})", x, extra=(k,), reach=(max(-k, 0), max(k, 0)))


def delta(x, k: int = 1) -> E:
    return wrap(x) - lag(x, k)


def _skew(v: Column, w) -> Column:
    n = F.count(v).over(w)
    return F.when(n >= 3, F.skewness(v).over(w) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(v: Column, w) -> Column:
    n = F.count(v).over(w)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v).over(w) + 6))


_ROLLS: dict[str, tuple[Callable, str]] = {
    "avg": (lambda v, w: F.avg(v).over(w), "avg"),
    "sum": (lambda v, w: F.sum(v).over(w), "sum"),
    "min": (lambda v, w: F.min(v).over(w), "min"),
    "max": (lambda v, w: F.max(v).over(w), "max"),
    "std0": (lambda v, w: F.stddev_pop(v).over(w), "stddev_pop"),
    "std1": (lambda v, w: F.stddev_samp(v).over(w), "stddev_samp"),
    "skew": (_skew, "skewness"),
    "kurt": (_kurt, "kurtosis"),
}


def roll(kind: str, x, n: int, least: int | None = None) -> E:
    """An aggregate of the last n rows, given `least` values among them (n, unless said)."""
    least = n if least is None else max(1, least)
    frame, w_sql = _frame(n)
    fn, name = _ROLLS[kind]

    def column(v: Column) -> Column:
        w = frame()
        out = F.when(F.count(v).over(w) >= least, fn(v, w))
        return F.when(F.min(v).over(w) == F.max(v).over(w), F.when(F.count(v).over(w) >= max(least, 1 + (kind == "std1")), F.lit(0.0))).otherwise(out) if kind in ("std0", "std1") else out

    def text(v: str) -> str:
        out = f"CASE WHEN count({v}) OVER {w_sql} >= {least} THEN {name}({v}) OVER {w_sql} END"
        if kind in ("std0", "std1"):  # a constant window is exactly 0
            return f"(CASE WHEN min({v}) OVER {w_sql} = max({v}) OVER {w_sql} THEN CASE WHEN count({v}) OVER {w_sql} >= {max(least, 1 + (kind == 'std1'))} THEN 0.0 END ELSE {out} END)"
        return f"({out})"

    return make(f"roll_{kind}", "T", column, text, x, extra=(n, least), reach=(n - 1, 0))


def cumsum(x) -> E:
    return make("cumsum", "T", lambda v: F.sum(v).over(_t().rowsBetween(Window.unboundedPreceding, 0)), lambda v: f"sum({v}) OVER ({_T_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", x)


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def rcorr(x, y, n: int, least: int | None = None, flat: float | None = 0.0) -> E:
    """Pearson correlation of the last n rows where both are there; `flat` where one of them does not vary.

    Of two rows it is 1 or -1: the product of the signs of the changes, which has no last bits to rank by.
    """
    least = n if least is None else least
    frame, w_sql = _frame(n)

    def column(a: Column, b: Column) -> Column:
        w = frame()
        a, b = _pair(a, b)
        still = (F.min(a).over(w) == F.max(a).over(w)) | (F.min(b).over(w) == F.max(b).over(w))
        if n == least == 2:
            corr = F.signum(a - F.first(a).over(w)) * F.signum(b - F.first(b).over(w))
        else:
            corr = F.round(F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)), 10)
        return F.when(F.count(a).over(w) >= least, F.when(still, F.lit(flat).cast("double")).otherwise(corr))

    def text(a: str, b: str) -> str:
        p = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
        q = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
        still = f"(min({p}) OVER {w_sql} = max({p}) OVER {w_sql} OR min({q}) OVER {w_sql} = max({q}) OVER {w_sql})"
        corr = f"round(covar_pop({p}, {q}) OVER {w_sql} / nullif(stddev_pop({p}) OVER {w_sql} * stddev_pop({q}) OVER {w_sql}, 0), 10)"
        if n == least == 2:
            corr = " * ".join(f"CAST(sign({x} - first_value({x}) OVER {w_sql}) AS DOUBLE)" for x in (p, q))
        return f"(CASE WHEN count({p}) OVER {w_sql} >= {least} THEN CASE WHEN {still} THEN {'CAST(NULL AS DOUBLE)' if flat is None else flat} ELSE {corr} END END)"

    return make("rcorr", "T", column, text, x, y, extra=(n, least, flat), reach=(n - 1, 0))


def rcov(x, y, n: int) -> E:
    """Sample covariance of a full window."""
    frame, w_sql = _frame(n)

    def column(a: Column, b: Column) -> Column:
        w = frame()
        a, b = _pair(a, b)
        return F.when(F.count(a).over(w) >= n, F.round(F.covar_samp(a, b).over(w), 10))

    def text(a: str, b: str) -> str:
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        return f"(CASE WHEN count(CASE WHEN {both} THEN 1 END) OVER {w_sql} >= {n} THEN round(covar_samp({a}, {b}) OVER {w_sql}, 10) END)"

    return make("rcov", "T", column, text, x, y, extra=(n,), reach=(n - 1, 0))


def tsrank(x, n: int) -> E:
    """Average rank of the last value in a full window, scaled to 0..1."""
    frame, w_sql = _frame(n)

    def column(v: Column) -> Column:
        w = frame()
        got = F.collect_list(v).over(w)
        less = F.size(F.filter(got, lambda z: z < v))
        same = F.size(F.filter(got, lambda z: z == v))
        return F.when((F.size(got) == n) & v.isNotNull(), (less + (same + 1) / 2 - 1) / (n - 1))

    def text(v: str) -> str:
        got = f"list({v}) OVER {w_sql}"
        return f"(CASE WHEN count({v}) OVER {w_sql} = {n} THEN (len(list_filter({got}, lambda z: z < {v})) + (len(list_filter({got}, lambda z: z = {v})) + 1) / 2.0 - 1) / {n - 1} END)"

    return make("tsrank", "T", column, text, x, extra=(n,), reach=(n - 1, 0))


def since_max(x, n: int) -> E:
    """Rows since the first greatest value of a full window; 0 is the current row."""
    frame, w_sql = _frame(n)
    return make(
        "since_max", "T",
        lambda v: F.when(F.size(F.collect_list(v).over(frame())) == n, n - F.array_position(F.collect_list(v).over(frame()), F.max(v).over(frame()))).cast("double"),
        lambda v: f"CAST(CASE WHEN count({v}) OVER {w_sql} = {n} THEN {n} - list_position(list({v}) OVER {w_sql}, max({v}) OVER {w_sql}) END AS DOUBLE)",
        x, extra=(n,), reach=(n - 1, 0),
    )


SPAN, STEEPEST = 100.0, 300.0


def _running(name: str, column: Callable[[Column], Column], text: str, x, upto: int = 0) -> E:
    """An aggregate of all rows of an item up to `upto` rows after (before, if negative) the current one."""
    end = "CURRENT ROW" if upto == 0 else f"{-upto} PRECEDING"
    frame = f"({_T_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
    return make(name, "T", lambda v: column(v).over(_t().rowsBetween(Window.unboundedPreceding, upto)), lambda v: f"{text.format(v)} OVER {frame}", x, extra=(upto,))


def ewm(x, alpha: float, least: int = 1) -> E:
    """Recursive mean y = y + alpha (x - y) from the first value on; a gap lets the old weight decay, as in pandas with adjust=False.

    A prefix scan of affine maps y -> a y + b x. With c the running sum of -ln a, y is exp(-c) times the running sum of b x exp(c);
    to keep exp(c) in range an item's rows are cut into blocks of SPAN in c, and c counts from its block's start. A block takes over the sum of the one before it,
    times exp(-SPAN); what lies further back weighs under 1e-43. Each row is seen a fixed number of times, whatever the length or the gaps.
    """
    v = wrap(x)
    at = make("row_number", "T", lambda _: F.row_number().over(_t()), lambda _: f"row_number() OVER ({_T_SQL})", v)
    before = _running("last_at", F.max, "max({})", row("at", lambda x, i: F.when(x.isNotNull(), i), lambda x, i: f"CASE WHEN {x} IS NOT NULL THEN {i} END", v, at), -1)
    keep = make("ewm_keep", "", lambda i, j: F.pow(F.lit(1 - alpha), i - j), lambda i, j: f"pow({1 - alpha!r}, {i} - {j})", at, before, extra=(alpha,))
    step = make(
        "ewm_step", "",
        lambda x, k: F.when(x.isNull() | k.isNull(), 0.0).otherwise(F.least(F.log((k + alpha) / F.greatest(k, F.lit(1e-300))), F.lit(STEEPEST))),
        lambda x, k: f"CASE WHEN {x} IS NULL OR {k} IS NULL THEN 0.0 ELSE least(ln(({k} + {alpha!r}) / greatest({k}, 1e-300)), {STEEPEST}) END",
        v, keep, extra=(alpha,),
    )
    decay = cumsum(step)
    block = row("ewm_block", lambda c: F.floor(c / SPAN), lambda c: f"floor({c} / {SPAN})", decay)
    within = row("ewm_within", lambda c, b: c - b * SPAN, lambda c, b: f"({c} - {b} * {SPAN})", decay, block)
    part = make(
        "ewm_part", "",
        lambda x, k, e: F.when(x.isNull(), 0.0).otherwise(F.when(k.isNull(), x).otherwise(x * alpha / (k + alpha)) * F.exp(e)),
        lambda x, k, e: f"CASE WHEN {x} IS NULL THEN 0.0 ELSE CASE WHEN {k} IS NULL THEN {x} ELSE {x} * {alpha!r} / ({k} + {alpha!r}) END * exp({e}) END",
        v, keep, within, extra=(alpha,),
    )
    own = make(
        "ewm_own", "T",
        lambda p, b: F.sum(p).over(Window.partitionBy(ITEM, b).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)),
        lambda p, b: f"sum({p}) OVER (PARTITION BY {ITEM}, {b} ORDER BY {DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        part, block,
    )
    last = make(
        "ewm_last", "T",
        lambda p, b: F.sum(p).over(Window.partitionBy(ITEM).orderBy(b).rangeBetween(-1, -1)),
        lambda p, b: f"sum({p}) OVER (PARTITION BY {ITEM} ORDER BY {b} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)",
        part, block,
    )
    n = _running("seen", F.count, "count({})", v)

    def column(_: Column, own: Column, last: Column, within: Column, n: Column) -> Column:
        return F.when(n >= max(1, least), F.exp(-within) * (own + F.coalesce(last, F.lit(0.0)) * F.exp(F.lit(-SPAN))))

    def text(v: str, *_: str) -> str:
        """The recursion itself, value after value; for series without inner gaps."""
        frame = f"({_T_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        state = f"list_reduce(list_filter(list({v}) OVER {frame}, lambda z: z IS NOT NULL), lambda y, z: y + {alpha!r} * (z - y))"
        return f"(CASE WHEN count({v}) OVER {frame} >= {max(1, least)} THEN {state} END)"

    return make("ewm", "T", column, text, v, own, last, within, n, extra=(alpha, least))


# Windows across the items of a date.

def csrank(x) -> E:
    """Average rank among the values of the date, scaled to 0..1; alone: 0.5."""

    def column(v: Column) -> Column:
        order = _x().orderBy(v.asc_nulls_last())
        peers = order.rangeBetween(Window.currentRow, Window.currentRow)
        n = F.count(v).over(_x())
        r = F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2
        return F.when(v.isNotNull(), F.when(n == 1, F.lit(0.5)).otherwise(F.try_divide(r - 1, n - 1)))

    def text(v: str) -> str:
        order = f"PARTITION BY {DATE} ORDER BY {v} ASC NULLS LAST"
        n = f"count({v}) OVER (PARTITION BY {DATE})"
        r = f"(rank() OVER ({order}) + (count(*) OVER ({order} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0)"
        return f"(CASE WHEN {v} IS NOT NULL THEN CASE WHEN {n} = 1 THEN 0.5 ELSE ({r} - 1) / nullif({n} - 1, 0) END END)"

    return make("csrank", "X", column, text, x)


def over_date(kind: str, x) -> E:
    """avg, sum, count, std0 or median of a date's values."""
    fn = {"avg": F.avg, "sum": F.sum, "count": F.count, "std0": F.stddev_pop, "median": F.median, "min": F.min, "max": F.max}[kind]
    name = {"std0": "stddev_pop"}.get(kind, kind)
    return make(f"date_{kind}", "X", lambda v: fn(v).over(_x()), lambda v: f"{name}({v}) OVER (PARTITION BY {DATE})", x)


def scale(x, target: float = 1.0) -> E:
    """x over the date's sum of |x|; 0 where that sum is 0."""
    total = over_date("sum", absolute(x))
    return when(total > EPS, mul(x, target) / total, given(x, lit(0.0)))
