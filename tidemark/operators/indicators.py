"""Technical indicators by name: ``name -> Step`` over one or more input columns.

All windowed indicators need a full window.  Indicators with infinite memory (EMA and
relatives) are in ``recursive``, because they are scans and not frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.frame import Kernel, SeriesFrame, Span, Step
from tidemark.functions.numeric import ratio
from tidemark.operators import doubling as D
from tidemark.operators import recursive
from tidemark.operators.levels import Tree, window
from tidemark.operators.raster import interpolate
from tidemark.operators.rolling import centred, convert_to_relative, rolling, slope

Inputs = dict[str, str]


def _one(inputs: Inputs) -> str:
    return inputs["real"]


def _row(name: str, value: Callable[[Span], Column], lookback: int = 0) -> Step:
    return Step([name], [lambda span: {name: value(span)}], lookback, 0)


# -- averages and spread ---------------------------------------------------------------------


def _strict(fn: str) -> Callable[[Inputs, int, str], Step]:
    return lambda inputs, w, name: rolling(_one(inputs), fn, w, name, strict=True)


def _from_steps(name: str, w: int, steps: list[Step], value: Callable[[Span], Column]) -> Step:
    """A value of the results of other steps over the same window."""
    return Step([name], [*D.together(*[s.phases for s in steps]), lambda span: {name: value(span)}], w - 1, 0)


def _range(high: str, low: str, w: int, name: str) -> tuple[list[Step], Column, Column]:
    """Largest value of one column and smallest of another over full windows."""
    top, bottom = f"__top_{name}", f"__bottom_{name}"
    return [rolling(high, "max", w, top, strict=True), rolling(low, "min", w, bottom, strict=True)], F.col(top), F.col(bottom)


def _midpoint(inputs: Inputs, w: int, name: str) -> Step:
    steps, top, bottom = _range(_one(inputs), _one(inputs), w, name)
    return _from_steps(name, w, steps, lambda span: (top + bottom) / 2)


def _wma(inputs: Inputs, w: int, name: str) -> Step:
    c = _one(inputs)
    counts, n = D.known_values(c, w)
    phases, held = D.windowed(f"weighted:{c}", D.weighted_total(c), w)
    return Step([name], [*D.together(counts, phases), lambda span: {name: F.when(F.col(n) == w, F.col(held["u"]) / (w * (w + 1) / 2))}], w - 1, 0)


def _trima(inputs: Inputs, w: int, name: str) -> Step:
    c = _one(inputs)
    inner, outer = (w // 2, w // 2 + 1) if w % 2 == 0 else ((w + 1) // 2, (w + 1) // 2)
    first, second = rolling(c, "mean", inner, f"__sma_{name}", strict=True), rolling(f"__sma_{name}", "mean", outer, name, strict=True)
    return Step([name], [*first.phases, *second.phases], inner + outer - 2, 0)


def _extreme_place(largest: bool) -> Callable[[Inputs, int, str], Step]:
    def build(inputs: Inputs, w: int, name: str) -> Step:
        c = _one(inputs)
        counts, n = D.known_values(c, w)

        def place(span: Span) -> Column:
            value = F.col(c) if largest else -F.col(c)
            return F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(span.pos).alias("at")))

        phases, top = D.extreme(f"{'last' if largest else 'low'}:{c}", place, True, w)
        return Step([name], [*D.together(counts, phases), lambda span: {name: F.when(F.col(n) == w, F.col(top)["at"])}], w - 1, 0)

    return build


# -- regression ------------------------------------------------------------------------------


def _regression(kind: str) -> Callable[[Inputs, int, str], Step]:
    def build(inputs: Inputs, w: int, name: str) -> Step:
        c = _one(inputs)
        m_name, mean_name = f"__slope_{name}", f"__mean_{name}"
        m, mean = slope(c, w, m_name, need=w), rolling(c, "mean", w, mean_name, strict=True)
        phases = [lambda span, k=k: {**(m.phases[k](span) if k < len(m.phases) else {}),
                                     **(mean.phases[k](span) if k < len(mean.phases) else {})}
                  for k in range(max(len(m.phases), len(mean.phases)))]

        def result(span: Span) -> dict[str, Column]:
            b = F.col(m_name)
            start = F.col(mean_name) - b * ((w - 1) / 2)
            value = {
                "slope": b,
                "intercept": start,
                "end": start + b * (w - 1),
                "forecast": start + b * w,
                "angle": F.atan(b) * (180.0 / math.pi),
            }[kind]
            return {name: value}

        return Step([name], [*phases, result], w - 1, 0)

    return build


# -- momentum --------------------------------------------------------------------------------


def _momentum(kind: str) -> Callable[[Inputs, int, str], Step]:
    def build(inputs: Inputs, w: int, name: str) -> Step:
        c = _one(inputs)

        def value(span: Span) -> Column:
            now, before = F.col(c), F.lag(c, w).over(span.ordered)
            if kind == "mom":
                return now - before
            change = {
                "roc": (ratio(now, before) - 1) * 100.0,
                "rocp": ratio(now - before, before),
                "rocr": ratio(now, before),
                "rocr100": ratio(now, before) * 100.0,
            }[kind]
            return F.when(before == 0, F.lit(0.0) * now).otherwise(change)

        return _row(name, value, w)

    return build


# -- two columns -----------------------------------------------------------------------------


def _correl(inputs: Inputs, w: int, name: str) -> Step:
    a, b = inputs["real0"], inputs["real1"]
    phases, held = D.windowed(f"pair:{a}:{b}", D.pair(a, b), w)

    def result(span: Span) -> dict[str, Column]:
        r = ratio(F.col(held["xy"]), F.sqrt(F.col(held["xx"])) * F.sqrt(F.col(held["yy"])))
        return {name: F.when(F.col(held["n"]) == w, F.when(r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r))}

    return Step([name], [*phases, result], w - 1, 0)


def _arithmetic(op: Callable[[Column, Column], Column]) -> Callable[[Inputs, int | None, str], Step]:
    return lambda inputs, w, name: _row(name, lambda s: op(F.col(inputs["real0"]), F.col(inputs["real1"])))


# -- price bars ------------------------------------------------------------------------------


def _prices(value: Callable[[dict[str, Column]], Column]) -> Callable[[Inputs, int | None, str], Step]:
    return lambda inputs, w, name: _row(name, lambda s: value({k: F.col(c) for k, c in inputs.items()}))


def true_range(inputs: Inputs, span: Span) -> Column:
    high, low = F.col(inputs["high"]), F.col(inputs["low"])
    before = F.lag(inputs["close"], 1).over(span.ordered)
    complete = high.isNotNull() & low.isNotNull() & before.isNotNull()
    return F.when(complete, F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


def _trange(inputs: Inputs, w: int | None, name: str) -> Step:
    return _row(name, lambda s: true_range(inputs, s), 1)


def _midprice(inputs: Inputs, w: int, name: str) -> Step:
    steps, top, bottom = _range(inputs["high"], inputs["low"], w, name)
    return _from_steps(name, w, steps, lambda span: (top + bottom) / 2)


def _willr(inputs: Inputs, w: int, name: str) -> Step:
    c = inputs["close"]
    steps, top, bottom = _range(inputs["high"], inputs["low"], w, name)
    closes = f"__closes_{name}"

    def value(span: Span) -> Column:
        share = F.when(top == bottom, F.lit(0.0)).otherwise(ratio((top - F.col(c)) * -100.0, top - bottom))
        return F.when((F.col(closes) == w) & top.isNotNull() & bottom.isNotNull(), share)

    return _from_steps(name, w, [*steps, rolling(c, "count", w, closes, strict=True)], value)


def _cci(inputs: Inputs, w: int, name: str) -> Kernel:
    columns = [inputs[k] for k in ("high", "low", "close")]

    def function(pos: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        typical = sum(values[c] for c in columns) / 3
        x = centred(typical)
        first, end = window(len(x), w, False)
        tree = Tree(x, w)
        n, total = (p := tree.parts(first, end, x)).n, p.total
        mean = np.divide(total, n, out=np.full(len(x), np.nan), where=n > 0)
        above, below = tree.parts(first, end, mean).areas(mean)
        away, spread = x - mean, (above + below) / w
        # equal values: nothing but rounding is left of the mean
        flat = (away == 0) | (spread <= 4 * np.finfo(float).eps * np.abs(typical))
        # Fixed value: Lambert's constant 0.015.
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(flat, 0.0, away / (spread * 0.015))
        return {name: np.where(n == w, value, np.nan)}

    return Kernel({name: "double"}, list(dict.fromkeys(columns)), function, w - 1)


# -- math ------------------------------------------------------------------------------------


def _math(fn: Callable[[Column], Column]) -> Callable[[Inputs, int | None, str], Step]:
    return lambda inputs, w, name: _row(name, lambda s: fn(F.col(_one(inputs))))


def _positive(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: fn(F.when(c > 0, c))


INDICATORS: dict[str, Callable[[Inputs, int | None, str], Step | Kernel]] = {
    "SMA": _strict("mean"), "SUM": _strict("sum"), "MAX": _strict("max"), "MIN": _strict("min"),
    "VAR": _strict("var"), "STDDEV": _strict("std"), "MIDPOINT": _midpoint,
    "LINEARREG": _regression("end"), "LINEARREG_SLOPE": _regression("slope"),
    "LINEARREG_INTERCEPT": _regression("intercept"), "LINEARREG_ANGLE": _regression("angle"),
    "TSF": _regression("forecast"),
    "MOM": _momentum("mom"), "ROC": _momentum("roc"), "ROCP": _momentum("rocp"), "ROCR": _momentum("rocr"),
    "ROCR100": _momentum("rocr100"),
    "WMA": _wma, "TRIMA": _trima, "MAXINDEX": _extreme_place(True), "MININDEX": _extreme_place(False),
    "CORREL": _correl,
    "ADD": _arithmetic(lambda a, b: a + b), "SUB": _arithmetic(lambda a, b: a - b),
    "MULT": _arithmetic(lambda a, b: a * b), "DIV": _arithmetic(ratio),
    "AVGPRICE": _prices(lambda p: (p["open"] + p["high"] + p["low"] + p["close"]) / 4),
    "MEDPRICE": _prices(lambda p: (p["high"] + p["low"]) / 2),
    "TYPPRICE": _prices(lambda p: (p["high"] + p["low"] + p["close"]) / 3),
    "WCLPRICE": _prices(lambda p: (p["high"] + p["low"] + p["close"] * 2) / 4),
    "TRANGE": _trange, "MIDPRICE": _midprice, "WILLR": _willr, "CCI": _cci,
    "LN": _math(_positive(F.ln)), "LOG10": _math(_positive(F.log10)),
    "SQRT": _math(lambda c: F.sqrt(F.when(c >= 0, c))), "EXP": _math(F.exp),
    "FLOOR": _math(lambda c: F.floor(c).cast("double")), "CEIL": _math(lambda c: F.ceil(c).cast("double")),
    "SIN": _math(F.sin), "COS": _math(F.cos), "TAN": _math(F.tan), "ATAN": _math(F.atan),
}


def input_columns(columns) -> Inputs:
    """Input columns by argument name."""
    if isinstance(columns, str):
        return {"real": columns}
    if isinstance(columns, dict):
        return dict(columns)
    if len(columns) == 1:
        return {"real": columns[0]}
    return {f"real{i}": c for i, c in enumerate(columns)}


def output_name(columns: list[str], function: str, w: int | None, names, index: int) -> str:
    if isinstance(names, list):
        return names[index]
    base = "_".join(columns)
    if not w:
        return names or f"{base}_{function}"
    return f"{base}_{function}_{names}_{w}" if names else f"{base}_{function}_{w}"


def indicators(frame: SeriesFrame, columns, functions, windows=None, names=None, rel_base: str | None = None,
               rel_func: str | None = None, percentage: bool = False, log: bool = False,
               fill_gaps: bool = True, compat: bool = False) -> tuple[SeriesFrame, list[str]]:
    """Indicators by name over several windows.

    Inputs are interpolated first unless ``fill_gaps`` is False (inputs known to be
    gapless).  The outputs of one function can be related to each other over its windows.
    """
    inputs = input_columns(columns)
    functions = functions if isinstance(functions, list) else [functions]
    windows = windows if isinstance(windows, list) else [windows]
    sources = list(inputs.values())
    if fill_gaps:
        renamed = {c: f"filled__{c}" for c in dict.fromkeys(sources)}
        frame = interpolate(frame, list(renamed), renamed)
        inputs = {k: renamed[c] for k, c in inputs.items()}
    steps, endless, groups, produced = [], [], [], []
    for fn in functions:
        outs = []
        for j, w in enumerate(windows):
            name = output_name(sources, fn, w, names, j)
            if w == 1 and len(inputs) == 1:
                c = _one(inputs)
                steps.append(_row(name, lambda s, c=c: F.col(c)))
            elif fn in recursive.RECURSIVE:
                endless.append((fn, inputs, w, name))
            elif fn in INDICATORS:
                steps.append(INDICATORS[fn](inputs, w, name))
            else:
                raise ValueError(f"unknown indicator {fn!r}")
            outs.append(name)
        groups.append(outs)
        produced.extend(outs)
    frame = recursive.recursive_indicators(frame, endless).derive(steps)
    final: dict[str, Column] = {}
    for outs in groups:
        values = convert_to_relative([F.col(n) for n in outs], rel_base, rel_func, percentage, compat)
        for n, v in zip(outs, values):
            final[n] = F.ln(F.when(v > 0, v)) if log else v
    if rel_base or percentage or log:
        frame = frame.with_columns(final)
    if fill_gaps:
        frame = frame.with_df(frame.df.drop(*[f"filled__{c}" for c in sources]))
    return frame, produced
