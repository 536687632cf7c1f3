"""Windows of mergeable states.

The state of 2k rows is the state of the last k rows merged with that of the k rows before them, which
``lag`` fetches.  A window of w rows merges one state for each binary digit of w.  All states and windows
of a stage share one sort order and take one window node per doubling, so a window costs O(log w) per
row.  Nothing is ever subtracted: a value that is huge or not finite leaves with its window, and equal
values have exactly no spread.

Every state over a column (or a pair of columns) has named fields, one DataFrame column each.  Columns
of a level, of a lag and of a part of a window carry names made of state, column and place, so that steps
of one stage that need the same state compute it once.  Future windows are past windows of a later row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.frame import Phase, Span


@dataclass(frozen=True)
class State:
    """Fields of one row, and how an older run (``a.x`` for field x) is merged with a newer one (``b.x``).

    Merges are SQL texts; ``{rows}`` stands for the length of the older run.  A run of no rows
    has ``empty`` in its fields.
    """

    fields: dict[str, Callable[[Span], Column]]
    merge: dict[str, str]
    empty: float | None = 0.0


def _zero(span: Span) -> Column:
    return F.lit(0.0)


def _real(c: str) -> Callable[[Span], Column]:
    return lambda span: F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def total(c: str) -> State:
    """``s``: the sum; whole numbers stay whole."""
    return State({"s": lambda span: F.coalesce(F.col(c), F.lit(0)) + F.lit(0).cast("long")}, {"s": "coalesce(a.s, 0) + b.s"}, None)


def weighted_total(c: str) -> State:
    """``s`` and ``u``: the sum, and the sum weighted by 1, 2, ... from the oldest row on."""
    return State({"s": _real(c), "u": _real(c)}, {"s": "a.s + b.s", "u": "a.u + b.u + b.s * {rows}"})


_BOTH = "greatest(a.n + b.n, 1D)"
_EACH = f"(a.n * b.n / {_BOTH})"


def _mean(x: str) -> str:
    return f"a.{x} + (b.{x} - a.{x}) * (b.n / {_BOTH})"


def _product(q: str, x: str, y: str) -> str:
    return f"a.{q} + b.{q} + (b.{x} - a.{x}) * (b.{y} - a.{y}) * {_EACH}"


def moments(c: str, order: int = 2) -> State:
    """``n``, ``m`` and ``q2`` to ``q4``: number, mean and sums of powers of differences to it."""
    d = "(b.m - a.m)"
    fields = {"n": lambda span: F.col(c).isNotNull().cast("double"), "m": _real(c), "q2": _zero}
    merge = {"n": "a.n + b.n", "m": _mean("m"), "q2": _product("q2", "m", "m")}
    if order > 2:
        fields |= {"q3": _zero, "q4": _zero}
        merge["q3"] = f"a.q3 + b.q3 + {d} * {d} * {d} * {_EACH} * ((a.n - b.n) / {_BOTH}) + 3 * {d} * (a.n * b.q2 - b.n * a.q2) / {_BOTH}"
        merge["q4"] = (f"a.q4 + b.q4 + {d} * {d} * {d} * {d} * {_EACH} * ((a.n * a.n - a.n * b.n + b.n * b.n) / ({_BOTH} * {_BOTH}))"
                       f" + 6 * {d} * {d} * (a.n * a.n * b.q2 + b.n * b.n * a.q2) / ({_BOTH} * {_BOTH}) + 4 * {d} * (a.n * b.q3 - b.n * a.q3) / {_BOTH}")
    return State(fields, merge)


def line(c: str) -> State:
    """A column over its position: ``n``, means ``x`` and ``m``, spread ``xx`` of the positions, ``xm`` of the products."""
    fields = {"n": lambda span: F.col(c).isNotNull().cast("double"), "m": _real(c),
              "x": lambda span: F.when(F.col(c).isNotNull(), F.col(span.pos).cast("double")).otherwise(0.0), "xx": _zero, "xm": _zero}
    return State(fields, {"n": "a.n + b.n", "m": _mean("m"), "x": _mean("x"), "xx": _product("xx", "x", "x"), "xm": _product("xm", "x", "m")})


def pair(a: str, b: str) -> State:
    """Two columns where both are known: ``n``, means, spreads ``xx`` and ``yy``, and ``xy`` of the products."""
    known = lambda: F.col(a).isNotNull() & F.col(b).isNotNull()
    fields = {"n": lambda span: known().cast("double"), "x": lambda span: F.when(known(), F.col(a).cast("double")).otherwise(0.0),
              "y": lambda span: F.when(known(), F.col(b).cast("double")).otherwise(0.0), "xx": _zero, "yy": _zero, "xy": _zero}
    return State(fields, {"n": "a.n + b.n", "x": _mean("x"), "y": _mean("y"), "xx": _product("xx", "x", "x"), "yy": _product("yy", "y", "y"),
                          "xy": _product("xy", "x", "y")})


def edges(c: str) -> State:
    """``f1``, ``f2``, ``l2``, ``l1``: the first two and the last two known values."""
    value = lambda span: F.col(c).cast("double")
    none = lambda span: F.lit(None).cast("double")
    return State({"f1": value, "f2": none, "l1": value, "l2": none}, {
        "f1": "coalesce(a.f1, b.f1)", "f2": "coalesce(a.f2, CASE WHEN a.f1 IS NULL THEN b.f2 ELSE b.f1 END)",
        "l1": "coalesce(b.l1, a.l1)", "l2": "coalesce(b.l2, CASE WHEN b.l1 IS NULL THEN a.l2 ELSE a.l1 END)"}, None)


def _level(base: str, field: str, j: int) -> str:
    return f"__{field}~{base}~{j}"


def _lags(base: str, fields: list[str], j: int, offsets: list[int], empty: float | None) -> Phase:
    def phase(span: Span) -> dict[str, Column]:
        return {f"{_level(base, f, j)}~{o}": F.lag(_level(base, f, j), o, empty).over(span.ordered) for f in fields for o in offsets}

    return phase


_FIELD = re.compile(r"\b([ab])\.(\w+)")


def _merge(state: State, older: Callable[[str], str], newer: Callable[[str], str], rows: int, into: Callable[[str], str]) -> dict[str, Column]:
    """Columns of the merged run; SQL texts, as a column for every operation would be slow to build."""
    side = {"a": older, "b": newer}
    return {into(f): F.expr(_FIELD.sub(lambda m: f"`{side[m[1]](m[2])}`", text.format(rows=rows))) for f, text in state.merge.items()}


def windowed(base: str, state: State, w: int) -> tuple[list[Phase], dict[str, str]]:
    """Phases that compute ``state`` over the last ``w`` rows, and the columns that hold its fields then.

    ``base`` names the input: equal bases and field names mean equal columns.
    """
    fields, top, covered, held = list(state.fields), w.bit_length() - 1, 0, {}

    def first(span: Span) -> dict[str, Column]:
        return {_level(base, f, 0): init(span) for f, init in state.fields.items()}

    phases: list[Phase] = [first]
    for j in range(top + 1):
        size, offsets, merges = 1 << j, [], []
        if j < top:
            offsets.append(size)
            merges.append((size, {f: _level(base, f, j) for f in fields}, {f: _level(base, f, j + 1) for f in fields}))
        if w & size:
            if covered:
                offsets.append(covered)
                into = {f: f"__{f}~{base}~of~{covered + size}" for f in fields}
                merges.append((covered, held, into))
                held = into
            else:
                held = {f: _level(base, f, j) for f in fields}
            covered += size
        phases.append(_lags(base, fields, j, list(dict.fromkeys(offsets)), state.empty))

        def merge(span: Span, j=j, merges=merges) -> dict[str, Column]:
            out = {}
            for offset, newer, into in merges:
                out |= _merge(state, lambda f: f"{_level(base, f, j)}~{offset}", newer.__getitem__, 1 << j, into.__getitem__)
            return out

        phases.append(merge)
    return phases, held


def extreme(base: str, value: Callable[[Span], Column], largest: bool, w: int) -> tuple[list[Phase], str]:
    """Phases for the largest or smallest known value (any ordered type) of the last ``w`` rows, and its column.

    Overlaps do no harm here, so two runs of the largest power of two cover the window.
    """
    field = "max" if largest else "min"
    pick = F.greatest if largest else F.least
    top = w.bit_length() - 1
    phases: list[Phase] = [lambda span: {_level(base, field, 0): value(span)}]
    for j in range(top):
        phases.append(_lags(base, [field], j, [1 << j], None))
        phases.append(lambda span, j=j: {_level(base, field, j + 1): pick(F.col(_level(base, field, j)), F.col(f"{_level(base, field, j)}~{1 << j}"))})
    rest = w - (1 << top)
    if not rest:
        return phases, _level(base, field, top)
    name = f"__{field}~{base}~of~{w}"
    phases.append(_lags(base, [field], top, [rest], None))
    phases.append(lambda span: {name: pick(F.col(_level(base, field, top)), F.col(f"{_level(base, field, top)}~{rest}"))})
    return phases, name


def known_values(c: str, w: int) -> tuple[list[Phase], str]:
    """Phases for the number of known values of the last ``w`` rows: whole numbers, so a difference of counts is exact."""
    count, name = f"__count~{c}", f"__count~{c}~of~{w}"
    return [lambda span: {count: F.count(c).over(span.running)},
            lambda span: {f"{count}~{w}": F.lag(count, w).over(span.ordered)},
            lambda span: {name: F.col(count) - F.coalesce(F.col(f"{count}~{w}"), F.lit(0))}], name


def together(*parts: list[Phase]) -> list[Phase]:
    """Phases side by side."""

    def phase(k: int) -> Phase:
        def run(span: Span) -> dict[str, Column]:
            out: dict[str, Column] = {}
            for p in parts:
                if k < len(p):
                    out |= p[k](span)
            return out

        return run

    return [phase(k) for k in range(max(len(p) for p in parts))]
