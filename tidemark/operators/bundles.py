"""Ready-made feature bundles of bar and order-book columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.frame import Kernel, SeriesFrame, Step, renamed, step
from tidemark.functions.numeric import ratio
from tidemark.operators.rolling import area_ratio, linear_trends, means_against_base, past_weighted_aggregations, percent_change, rolling

# The parts of the market bundle.
MARKET_PARTS = ["close_WMA", "close_STD", "volume_SMA", "span_SMA", "trades_SMA", "tb_base_SMA", "close_AREA",
                "close_SLOPE", "volume_SLOPE"]

# Columns, windows and base window of the depth bundle.
DEPTH_COLUMNS = ["gap", "bids_1", "asks_1", "bids_2", "asks_2", "bids_5", "asks_5", "bids_10", "asks_10", "bids_20", "asks_20"]
DEPTH_WINDOWS, DEPTH_BASE = [2, 5, 10], 30


def _against_base(source: str, fn: str, base: int, windows: list[int], name: str) -> tuple[list[Step], list[Step], list[str]]:
    """Rolling values relative (in percent) to the same aggregate over a longer window."""
    base_name = f"__base_{name}"
    names = [f"{name}_{w}" for w in windows]
    return ([rolling(source, fn, base, base_name)],
            [rolling(source, fn, w, n, rel_column=base_name, rel_factor=100.0) for w, n in zip(windows, names)], names)


def market_bundle(frame: SeriesFrame, windows: list[int], base_window: int, functions: list[str] | None = None,
                  use_differences: bool = True) -> tuple[SeriesFrame, list[str]]:
    """Price, volume, span, trade and taker-share features over several windows.

    With ``use_differences`` close, volume and trades are first replaced (for this bundle
    only) by their percent change to the previous row.
    """
    parts = functions or MARKET_PARTS
    unknown = set(parts) - set(MARKET_PARTS)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}")
    source = {c: f"__{c}" for c in ("close", "volume", "trades")}
    if use_differences:
        prepare = [percent_change(c, s) for c, s in source.items() if c in frame.df.columns]
    else:
        prepare = [step(s, lambda span, c=c, s=s: {s: F.col(c).cast("double")}) for c, s in source.items() if c in frame.df.columns]
    derived = {"span": lambda: F.col("high") - F.col("low"), "tb_base": lambda: ratio(F.col("tb_base_av"), F.col(source["volume"]))}
    needs = {"span_SMA": "span", "tb_base_SMA": "tb_base"}
    second = [step(f"__{d}", lambda span, d=d: {f"__{d}": derived[d]()}) for part, d in needs.items() if part in parts]

    bases: list[Step] = []
    outputs: list[Step | Kernel] = []
    names: list[str] = []
    if "close_WMA" in parts:
        close, volume = source["close"], source["volume"]
        bases.append(renamed(past_weighted_aggregations(close, volume, "mean", base_window)[0], "__base_wma"))
        for w, s in zip(windows, past_weighted_aggregations(close, volume, "mean", windows, "_wma", "__base_wma", 100.0)):
            outputs.append(renamed(s, f"close_{w}"))
            names.append(f"close_{w}")
    relative = [("close_STD", source["close"], "std", "close_std"), ("volume_SMA", source["volume"], "mean", "volume"),
                ("span_SMA", "__span", "mean", "span"), ("trades_SMA", source["trades"], "mean", "trades"),
                ("tb_base_SMA", "__tb_base", "mean", "tb_base")]
    for part, column, fn, name in relative:
        if part in parts:
            b, o, n = _against_base(column, fn, base_window, windows, name)
            bases += b
            outputs += o
            names += n
    plain = [("close_AREA", area_ratio, source["close"], "close_area"), ("close_SLOPE", linear_trends, source["close"], "close_trend"),
             ("volume_SLOPE", linear_trends, source["volume"], "volume_trend")]
    for part, build, column, name in plain:
        if part in parts:
            for w, s in zip(windows, build(column, windows)):
                outputs.append(renamed(s, f"{name}_{w}"))
                names.append(f"{name}_{w}")
    return frame.derive(prepare, second, bases, outputs), names


def depth_bundle(frame: SeriesFrame, book: dict[str, Column] | None = None) -> tuple[SeriesFrame, list[str]]:
    """Moving averages of 11 order-book columns relative to their longer average: 33 features.

    ``book`` makes columns of the order book from other columns of the row; they are added behind the shuffle.
    """
    names = [f"{c}_{w}" for c in DEPTH_COLUMNS for w in DEPTH_WINDOWS]
    means = means_against_base(DEPTH_COLUMNS, DEPTH_WINDOWS, DEPTH_BASE, 100.0)
    return frame.along(book or {}, dict.fromkeys(names, "double"), means, DEPTH_BASE - 1), names
