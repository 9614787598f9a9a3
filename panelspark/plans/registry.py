"""Factors of one's own beside the built-in ones, in the same plan.

    mine = Registry(FACTORS)

    @mine.factor("calm_momentum", deps=["momentum_20", "realized_vol_20"], window=5)
    def calm_momentum(momentum, vol):
        return roll("avg", momentum / vol, 5)

    mine.plan(["calm_momentum", "rsi_14"]).apply(panel)

A factor is a function of trees that gives a tree, so the planner shares its parts with all others and batches its windows with theirs. What trees cannot say
goes through vectorised(): a function of pandas Series, row by row over Arrow batches, or over the rows of a window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from panelspark.plans.expr import E, _t, col, make
from panelspark.plans.planner import Plan

COLUMNS = ("open", "high", "low", "close", "volume", "turnover")


@dataclass(frozen=True)
class Entry:
    deps: tuple[str, ...]
    build: Callable[..., E]
    window: int | None


class Registry:
    """built-in factors by name, the panel's columns, and what users add."""

    def __init__(self, built_in: dict[str, E] | None = None, columns: tuple[str, ...] = COLUMNS) -> None:
        self.built_in, self.columns = dict(built_in or {}), columns
        self.own: dict[str, Entry] = {}

    def _add(self, name: str, entry: Entry) -> None:
        if name in self.own or name in self.built_in or name in self.columns:
            raise ValueError(f"{name} is there already")
        self.own[name] = entry

    def factor(self, name: str, deps: list[str], window: int | None = None) -> Callable:
        """Registers a function of the trees of deps. window: the most rows its own windows may look back; None: not checked."""

        def add(build: Callable[..., E]) -> Callable[..., E]:
            self._add(name, Entry(tuple(deps), build, window))
            return build

        return add

    def vectorised(self, name: str, deps: list[str], window: int | None = None) -> Callable:
        """Registers a function of pandas Series: with a window, of an item's last `window` rows to a number, else of any rows to a Series."""

        def add(fn: Callable) -> Callable:
            import pandas as pd

            def text(*_: str) -> str:
                raise NotImplementedError(f"{name} has no SQL")

            def rows(*args):
                return fn(*args)

            def number(*args):
                return fn(*args)

            rows.__annotations__ = {"args": pd.Series, "return": pd.Series}
            number.__annotations__ = {"args": pd.Series, "return": float}

            def column(*args):
                made = F.pandas_udf(rows if window is None else number, "double")(*args)
                return made if window is None else made.over(_t().rowsBetween(-(window - 1), 0))

            def build(*trees: E) -> E:
                return make(f"vectorised_{name}", "" if window is None else "T", column, text, *trees, reach=(0, 0) if window is None else (window - 1, 0))

            self._add(name, Entry(tuple(deps), build, None))
            return fn

        return add

    def tree(self, name: str, above: tuple[str, ...] = ()) -> E:
        if name in above:
            raise ValueError(f"a cycle: {' -> '.join([*above[above.index(name):], name])}")
        if name in self.own:
            entry = self.own[name]
            deps = [self.tree(d, (*above, name)) for d in entry.deps]
            out = entry.build(*deps)
            if entry.window is not None:
                leaves = [E(d.key, (), "", d.column, d.text) for d in deps]
                back = Plan({name: entry.build(*leaves)}).reach()
                if any(b is None or b > entry.window for b, _ in back):
                    raise ValueError(f"{name} looks back further than its window of {entry.window}")
            return out
        if name in self.built_in:
            return self.built_in[name]
        if name in self.columns:
            return col(name)
        raise ValueError(f"{name} is neither a factor nor a column" + (f" (needed by {above[-1]})" if above else ""))

    def names(self) -> list[str]:
        return [*self.built_in, *self.own]

    def plan(self, names: list[str] | None = None) -> Plan:
        """One plan for these factors (all, unless said)."""
        return Plan({n: self.tree(n) for n in names or self.names()})
