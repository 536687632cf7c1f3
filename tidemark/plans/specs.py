"""Lists of generator specs applied to a series frame.

A spec is a plain dict ``{generator, column_prefix, feature_prefix, config}``.  A generator
is a Python function ``(frame, config) -> (frame, names)``; the result is one lazy plan.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import functions as F

from tidemark.frame import SeriesFrame, renamed
from tidemark.functions.numeric import clean
from tidemark.operators import bundles, extremum, labels, scores
from tidemark.operators.indicators import indicators
from tidemark.operators.raster import interpolate
from tidemark.operators.rolling import convert_to_relative, window_statistics

Generator = Callable[[SeriesFrame, dict], tuple[SeriesFrame, list[str]]]
PREFIX_HOLD = "kept__"


def _first_column(config: dict) -> str:
    columns = config.get("columns")
    if not columns:
        raise ValueError("'columns' is missing")
    if isinstance(columns, str):
        return columns
    return next(iter(columns.values())) if isinstance(columns, dict) else columns[0]


def _list(value) -> list:
    return value if isinstance(value, list) else [value]


def _relative_parameters(config: dict) -> dict:
    p = config.get("parameters", {})
    return {"rel_base": p.get("rel_base") or None, "rel_func": p.get("rel_func") or None,
            "percentage": bool(p.get("percentage")), "log": bool(p.get("log"))}


def _indicator(frame: SeriesFrame, config: dict):
    return indicators(frame, config["columns"], config["functions"], config.get("windows"), config.get("names"),
                      fill_gaps=config.get("interpolate", True), compat=config.get("compat", False),
                      **_relative_parameters(config))


# Other names under which the moment statistics are known.
STATISTIC_ALIASES = {
    "scipy_skew": "skew", "pandas_skew": "skew", "scipy_kurtosis": "kurtosis", "pandas_kurtosis": "kurtosis",
}


def _statistics(frame: SeriesFrame, config: dict, functions: list[str] | None = None):
    column = _first_column(config)
    wanted = functions or _list(config.get("functions"))
    windows, p = _list(config["windows"]), _relative_parameters(config)
    bias = config.get("parameters", {}).get("bias", False)
    source = column
    if config.get("interpolate", True):
        source = f"filled__{column}"
        frame = interpolate(frame, [column], {column: source})
    steps, groups = [], []
    for fn in wanted:
        known = STATISTIC_ALIASES.get(fn.lower(), fn.lower())
        made = window_statistics(source, [known], windows, bias)
        names = [f"{column}_{fn}_{w}" for w in windows]
        steps += [renamed(s, n) for s, n in zip(made, names)]
        groups.append(names)
    frame = frame.derive(steps)
    final = {}
    for names in groups:
        for n, v in zip(names, convert_to_relative([F.col(n) for n in names], p["rel_base"], p["rel_func"], p["percentage"])):
            final[n] = F.ln(F.when(v > 0, v)) if p["log"] else v
    frame = frame.with_columns(final)
    if source != column:
        frame = frame.with_df(frame.df.drop(source))
    return frame, [n for names in groups for n in names]


# The shape features, in order.
SHAPE_FEATURES = ["skew", "kurtosis", "msdc", "lsbm", "fmax"]


def _market(frame: SeriesFrame, config: dict):
    for needed in ("windows", "base_window"):
        if not config.get(needed):
            raise ValueError(f"'{needed}' has to be given")
    return bundles.market_bundle(frame, _list(config["windows"]), config["base_window"], config.get("functions"),
                                 config.get("use_differences", True))


def _smoothen(frame: SeriesFrame, config: dict):
    out = scores.smoothen(frame, config["columns"], config["names"], config.get("window"), config.get("point_threshold"))
    return out, [config["names"]]


def _combine(frame: SeriesFrame, config: dict):
    columns = config["columns"]
    if not isinstance(columns, list) or len(columns) != 2:
        raise ValueError("'columns' must list a buy score and a sell score")
    value = scores.combine(*columns, config.get("combine"), config.get("coefficient"), config.get("constant"))
    return frame.with_columns({config["names"]: value}), [config["names"]]


def _threshold_rule(frame: SeriesFrame, config: dict):
    p, column = config["parameters"], _first_column(config)
    buy, sell = scores.threshold_rule(column, p["buy_signal_threshold"], p["sell_signal_threshold"])
    return frame.with_columns(dict(zip(config["names"], (buy, sell)))), list(config["names"])


def _threshold_rule_two(frame: SeriesFrame, config: dict):
    p, columns = config["parameters"], config["columns"]
    if not isinstance(columns, list) or len(columns) != 2:
        raise ValueError("'columns' must list two scores")
    buy, sell = scores.threshold_rule_two(
        *columns, (p["buy_signal_threshold"], p["buy_signal_threshold_2"]),
        (p["sell_signal_threshold"], p["sell_signal_threshold_2"]))
    return frame.with_columns(dict(zip(config["names"], (buy, sell)))), list(config["names"])


def _constant(frame: SeriesFrame, config: dict):
    column, fn, value = config["columns"], config["function"], config["parameter"]
    if fn not in ("add", "mul"):
        raise ValueError(f"a constant can be used with add or mul, not {fn!r}")
    name = config.get("names") or f"{column}_{fn}"
    return frame.with_columns({name: F.col(column) + value if fn == "add" else F.col(column) * value}), [name]


GENERATORS: dict[str, Generator] = {
    "market": _market,
    "depth": lambda f, c: bundles.depth_bundle(f),
    "shape": lambda f, c: _statistics(f, c, SHAPE_FEATURES),
    "statistics": _statistics,
    "indicator": _indicator,
    "highlow": lambda f, c: labels.horizon_labels(f, c["horizon"]),
    "highlow2": lambda f, c: labels.first_cross_labels(
        f, c["columns"], c["function"], c["thresholds"], c["tolerance"], c["horizon"], c["names"]),
    "topbot": lambda f, c: extremum.tops_and_bottoms(f, c.get("columns", "close")),
    "topbot2": lambda f, c: extremum.top_or_bottom(f, c["columns"], c["function"], c["level"], c["tolerances"], c["names"]),
    "smoothen": _smoothen,
    "combine": _combine,
    "threshold_rule": _threshold_rule,
    "threshold_rule2": _threshold_rule_two,
    "constant": _constant,
}


def resolve_generator(generator) -> Generator:
    """A registered name, a callable, or ``package.module:function``."""
    if callable(generator):
        return generator
    if generator in GENERATORS:
        return GENERATORS[generator]
    module, _, function = str(generator).partition(":")
    if not function:
        raise ValueError(f"unknown generator {generator!r}")
    return getattr(importlib.import_module(module), function)


def apply_spec(frame: SeriesFrame, spec: dict) -> tuple[SeriesFrame, list[str]]:
    """Add the columns of one spec.

    With a column prefix the generator sees the columns of that prefix without it.  The
    feature prefix is put before its outputs, which replace columns of the same name.
    Everything stays in one plan; nothing is joined back.
    """
    generator, config = resolve_generator(spec["generator"]), spec.get("config", {})
    before = frame.df.columns
    fixed = [*frame.keys, frame.ts, frame.pos]
    held = [c for c in before if c not in fixed]
    column_prefix, feature_prefix = spec.get("column_prefix"), spec.get("feature_prefix")
    if column_prefix:
        head = column_prefix + "_"
        seen = {c[len(head):]: c for c in held if c.startswith(head)}
    else:
        seen = {c: c for c in held}
    view = frame.df.select(
        *fixed, *[F.col(c).alias(PREFIX_HOLD + c) for c in held], *[F.col(c).alias(short) for short, c in seen.items()])
    out, names = generator(frame.with_df(view), config)
    final = {n: f"{feature_prefix}_{n}" if feature_prefix else n for n in names}
    df = out.df.select(
        *fixed,
        *[F.col(PREFIX_HOLD + c).alias(c) for c in held if c not in final.values()],
        *[F.col(n).alias(f) for n, f in final.items()])
    return out.with_df(df), list(final.values())


def apply_specs(frame: SeriesFrame, specs: list[dict]) -> tuple[SeriesFrame, list[str]]:
    """Apply specs in order; later ones may read the columns of earlier ones."""
    names: list[str] = []
    for spec in specs:
        frame, new = apply_spec(frame, spec)
        names = [n for n in names if n not in new] + new
    return frame.with_df(clean(frame.df, names)), names
