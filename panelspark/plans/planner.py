"""Level batching: factor trees to as few projections and exchanges as their windows allow.

Windows cannot hold windows, and each change between windows along items ("T") and across dates ("X") is an exchange of
the whole panel. The planner shares equal subtrees, and adds all windows whose inputs are there, first those of the
current axis until none is left, then those of the other; so a set of factors costs one exchange per alternation on its
deepest path, however many factors there are. Row-wise parts stay inside the projection that needs them.

For a range of dates the planner knows how many rows back (and ahead) each tree looks, and reads no dates beyond them: between().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.plans.expr import DATE, ITEM, E


class Plan:
    def __init__(self, outputs: dict[str, E]) -> None:
        self.outputs = outputs
        self.windows: dict[str, E] = {}
        for e in outputs.values():
            self._collect(e)
        self.names = {k: f"_w{i}" for i, k in enumerate(self.windows)}
        self.levels: list[tuple[str, list[E]]] = []
        done: set[str] = set()
        left = dict(self.windows)
        axis = "T"
        while left:
            ready = [e for e in left.values() if e.axis == axis and all(k in done for k in self._below(e))]
            if not ready:
                axis = "X" if axis == "T" else "T"
                ready = [e for e in left.values() if e.axis == axis and all(k in done for k in self._below(e))]
            self.levels.append((axis, ready))
            done |= {e.key for e in ready}
            left = {k: e for k, e in left.items() if k not in done}

    def _collect(self, e: E) -> None:
        for a in e.args:
            self._collect(a)
        if e.axis:
            self.windows.setdefault(e.key, e)

    def _below(self, e: E) -> set[str]:
        """Windows that e's arguments hold."""
        out: set[str] = set()
        for a in e.args:
            if a.axis:
                out.add(a.key)
            else:
                out |= self._below(a)
        return out

    @property
    def exchanges(self) -> int:
        axes = [axis for axis, _ in self.levels]
        return sum(a != b for a, b in zip(axes, [None, *axes]))

    def reach(self) -> list[tuple[int | None, int]]:
        """Rows back and ahead along items, one pair for each stretch between windows across dates, the outermost first.

        A value across a date needs all items' values there, so its inputs' rows count from the dates that the outer ones reach.
        """

        def most(a: list, b: list) -> list:
            pairs = [(x, y) for x, y in zip(a + [(0, 0)] * len(b), b + [(0, 0)] * len(a))][: max(len(a), len(b))]
            return [(None if x[0] is None or y[0] is None else max(x[0], y[0]), max(x[1], y[1])) for x, y in pairs]

        seen: dict[str, list] = {}

        def chain(e: E) -> list:
            if e.key not in seen:
                own = [(0, 0)]
                for a in e.args:
                    own = most(own, chain(a))
                if e.axis == "T":
                    back, ahead = own[0]
                    own = [(None if back is None or e.reach[0] is None else back + e.reach[0], ahead + e.reach[1]), *own[1:]]
                elif e.axis == "X":
                    own = [(0, 0), *own]
                seen[e.key] = own
            return seen[e.key]

        out = [(0, 0)]
        for e in self.outputs.values():
            out = most(out, chain(e))
        return out

    def unbounded(self) -> list[str]:
        """Outputs that look back over a whole history."""
        return [name for name, e in self.outputs.items() if any(back is None for back, _ in Plan({name: e}).reach())]

    def between(self, panel: DataFrame, start: str | None, end: str | None, keep: list[str] | None = None) -> DataFrame:
        """apply() for the dates from start to end, both kept, without reading all of the panel: equal to filtering apply(panel).

        The first and last date needed come from a scan of (item, date) alone: rows, not days, count, so items that miss dates reach further. A plain range of
        dates goes below the windows and so to the scan. Trees that look back over a whole history are refused.
        """
        low, high = (None if d is None else F.lit(d).cast("date") for d in (start, end))
        first, last = low, high
        if low is not None and (whole := self.unbounded()):
            raise ValueError(f"a whole history is needed by {', '.join(whole)}")
        for back, ahead in self.reach():
            first, last = (None if at is None else _edge(panel, at, n, sign) for at, n, sign in ((first, back, -1), (last, ahead, 1)))
        for at, side in ((first, 1), (last, -1)):
            if at is not None:
                panel = panel.where(F.col(DATE) >= at if side > 0 else F.col(DATE) <= at)
        out = self.apply(panel, [ITEM, DATE, *[c for c in keep or [] if c not in (ITEM, DATE)]])
        for at, side in ((low, 1), (high, -1)):
            if at is not None:
                out = out.where(F.col(DATE) >= at if side > 0 else F.col(DATE) <= at)
        return out.select(*(keep or [ITEM, DATE]), *self.outputs)

    def _column(self, e: E, inner: bool = True) -> Column:
        if e.axis and inner:
            return F.col(self.names[e.key])
        return e.column(*[self._column(a) for a in e.args])

    def _text(self, e: E, inner: bool = True) -> str:
        if e.axis and inner:
            return self.names[e.key]
        return e.text(*[self._text(a) for a in e.args])

    def apply(self, panel: DataFrame, keep: list[str] | None = None) -> DataFrame:
        out = panel
        for _, level in self.levels:
            out = out.withColumns({self.names[e.key]: self._column(e, False) for e in level})
        return out.select(*(keep or [ITEM, DATE]), *[self._column(e).alias(name) for name, e in self.outputs.items()])

    def sql(self, source: str, keep: list[str] | None = None) -> str:
        """The same plan as DuckDB SQL over a subquery: one nested SELECT for each level."""
        inner = source
        for _, level in self.levels:
            inner = f"(SELECT *, {', '.join(f'{self._text(e, False)} AS {self.names[e.key]}' for e in level)} FROM {inner})"
        return f"SELECT {', '.join([*(keep or [ITEM, DATE]), *(f'{self._text(e)} AS {name}' for name, e in self.outputs.items())])} FROM {inner}"


def _edge(panel: DataFrame, at: Column, n: int, sign: int) -> Column:
    """The date that the n-th row of an item before (sign -1) or after `at` has, of all items the furthest one; `at` itself if none has any."""
    if not n:
        return at
    beyond = panel.select(ITEM, DATE).where(F.col(DATE) < at if sign < 0 else F.col(DATE) > at)
    order = Window.partitionBy(ITEM).orderBy(F.col(DATE).desc() if sign < 0 else F.col(DATE).asc())
    rows = beyond.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    found = rows.agg((F.min if sign < 0 else F.max)(DATE)).first()[0]
    return at if found is None else F.lit(found)
