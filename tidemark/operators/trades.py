"""Signals to alternating transactions, their performance, and parameter sweeps."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import BUCKET, KEY, SeriesFrame, Span, number_rows, join_on
from tidemark.functions.intervals import micros
from tidemark.functions.numeric import null_safe_false, ratio, round_down_text, round_text, truncate_decimal
from tidemark.operators.scores import threshold_rule, threshold_rule_two

# Fixed value: seconds of a month of 365/12 days.
MONTH_SECONDS = 2628000


def alternating_transactions(frame: SeriesFrame, buy: str, sell: str, price: str, grid_key: str | None = None) -> SeriesFrame:
    """Take the next buy, then the next sell, and so on; one event per row at most.

    Every signal row maps the state (long or flat) to a state: a buy sets it, a sell clears
    it, both together flip it.  Maps compose, so each bucket is summarised as 'ends long',
    'ends flat', 'flips' or 'keeps', and the composition is carried over the buckets.
    Rows without a price (NULL or 0) are skipped, rows without a signal change nothing.
    The result has the event rows only, with ``side``; positions are not dense any more.
    ``grid_key`` is the key of a parameter grid, if there is one.
    """
    b, s = null_safe_false(F.col(buy)), null_safe_false(F.col(sell))
    rows = frame.df.where((b | s) & F.col(price).isNotNull() & (F.col(price) != 0))
    by = list(frame.keys) if grid_key else [KEY]
    if BUCKET not in rows.columns:
        rows = frame.placed(rows)

    def compose(df: DataFrame, span: Span, sets: Column, flips: Column, prefix: str) -> DataFrame:
        """State map from the start of the span up to each row: (known, value) and flip."""
        df = df.withColumn(f"{prefix}n", F.sum(F.when(flips, 1).otherwise(0)).over(span.running))
        base = F.last(F.when(sets.isNotNull(), F.struct(sets.alias("v"), F.col(f"{prefix}n").alias("n"))), ignorenulls=True)
        df = df.withColumn(f"{prefix}b", base.over(span.running))
        known = F.col(f"{prefix}b")
        odd = (F.col(f"{prefix}n") - F.coalesce(known["n"], F.lit(0))) % 2 == 1
        # with a base the state is known; without one the entry state is kept or flipped
        return df.withColumns({f"{prefix}known": F.when(known.isNotNull(), known["v"] != odd), f"{prefix}flip": odd})

    span = Span((*by, BUCKET) if grid_key else (BUCKET, *by), frame.pos)
    rows = compose(rows, span, F.when(b != s, b), b & s, "__r")
    end = F.struct(F.col("__rknown").alias("known"), F.col("__rflip").alias("flip"))

    def scan(buckets: DataFrame, within: Span, across: Span, keys: list[str]) -> DataFrame:
        buckets = buckets.withColumns({"__sets": F.col("__end.known"), "__flips": F.col("__end.known").isNull() & F.col("__end.flip")})
        inner = compose(buckets, within, F.col("__sets"), F.col("__flips"), "__i")
        groups = inner.groupBy(*keys, "__group").agg(
            F.max_by(F.struct(F.col("__iknown").alias("known"), F.col("__iflip").alias("flip")), F.col(BUCKET)).alias("__gend"))
        groups = compose(
            groups, across, F.col("__gend.known"), F.col("__gend.known").isNull() & F.col("__gend.flip"), "__g")
        after_group = F.coalesce(F.col("__gknown"), F.col("__gflip"))
        groups = groups.select(*keys, "__group", F.coalesce(
            F.lag(after_group, 1).over(across.ordered), F.lit(False)).alias("__entry"))
        both = inner.join(groups, ["__group", *keys]) if keys == [KEY] else join_on(inner, groups, [*keys, "__group"])
        after = F.coalesce(F.col("__iknown"), F.col("__iflip") != F.col("__entry"))
        return both.select(*keys, BUCKET, "__group", F.coalesce(
            F.lag(after, 1).over(within.ordered), F.col("__entry")).alias("__before"))

    joined = frame._carry(rows, [F.max_by(end, F.col(frame.pos)).alias("__end")], scan, grid_key)
    state = F.coalesce(F.col("__rknown"), F.col("__rflip") != F.col("__before"))
    joined = joined.withColumn("__state", state)
    before = F.coalesce(F.lag("__state", 1).over(span.ordered), F.col("__before"))
    events = joined.withColumn("__prev", before).where(F.col("__state") != F.col("__prev"))
    events = events.withColumn("side", F.when(F.col("__state"), "BUY").otherwise("SELL"))
    return frame.with_df(events.drop(*[c for c in events.columns if c.startswith("__")]))


def transaction_profits(events: SeriesFrame, price: str, paired: bool = False) -> SeriesFrame:
    """Profit of each event against the previous event of the same side (0 for the first).

    With ``paired`` it is compared with the previous event of the other side.
    """
    p, side = F.col(price), F.col("side")
    out = events.fill(backward={"last_buy": F.when(side == "BUY", p), "last_sell": F.when(side == "SELL", p)}, strict=True)
    same, other = ("last_sell", "last_buy") if paired else ("last_buy", "last_sell")
    before = F.when(side == "BUY", F.col(same)).otherwise(F.col(other))
    usable = before > 0
    change = F.when(side == "BUY", before - p).otherwise(p - before)
    profit = F.when(usable, change).otherwise(F.lit(0.0))
    df = out.df.withColumns({
        "previous_price": F.coalesce(before, F.lit(0.0)),
        "profit": profit,
        "profit_percent": F.when(usable, ratio(profit * 100.0, before)).otherwise(F.lit(0.0)),
    }).drop("last_buy", "last_sell")
    return out.with_df(df)


def live_transactions(frame: SeriesFrame, buy: str, sell: str, price: str) -> SeriesFrame:
    """Transactions of the online rule: either side may start, rows with both signals do nothing.

    Profit is measured against the previous transaction, which is of the other side.
    """
    b, s = null_safe_false(F.col(buy)), null_safe_false(F.col(sell))
    rows = frame.df.where(b != s).withColumn("side", F.when(b, "BUY").otherwise("SELL"))
    signals = frame.with_df(rows).fill(backward={"prev_side": F.col("side")}, strict=True)
    kept = signals.with_df(signals.df.where(~F.col("side").eqNullSafe(F.col("prev_side"))).drop("prev_side"))
    out = kept.fill(backward={"prev_price": F.col(price)}, strict=True)
    p, before = F.col(price), F.col("prev_price")
    change = F.when(F.col("side") == "BUY", before - p).otherwise(p - before)
    profit = F.when(before.isNotNull() & (before != 0), change).otherwise(F.lit(0.0))
    return out.with_df(out.df.withColumn("profit", profit).drop("prev_price"))


# -- performance -----------------------------------------------------------------------------


def _measures(exact: Column | bool = False) -> list[Column]:
    """Totals; the two sums are rounded for one direction and exact for both together."""
    n = F.count(F.lit(1))
    profit = F.coalesce(F.sum("profit"), F.lit(0.0))
    percent = F.coalesce(F.sum("profit_percent"), F.lit(0.0))
    good = F.count_if(F.col("profit") > 0)
    zero, exact = F.lit(0.0), F.lit(exact) if isinstance(exact, bool) else exact
    named = {
        "transactions": n,
        "profit": F.when(exact, profit).otherwise(F.round(profit, 2)),
        "profit_percent": F.when(exact, percent).otherwise(F.round(percent, 1)),
        "profitable": good,
        "profitable_percent": F.coalesce(F.round(ratio(good * 100.0, n), 1), zero),
        "profit_per_transaction": F.coalesce(F.round(ratio(profit, n.cast("double")), 2), zero),
        "profit_percent_per_transaction": F.coalesce(F.round(ratio(percent, n.cast("double")), 1), zero),
    }
    return [c.alias(k) for k, c in named.items()]


# A sell ends a long position, a buy ends a short one.
DIRECTION_SIDE = {"long": "SELL", "short": "BUY"}


def performance(events: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per series for long, short and both, one row each."""
    spread = events.withColumn("direction", F.explode(F.array(
        F.when(F.col("side") == "SELL", "long").otherwise("short"), F.lit("both"))))
    return spread.groupBy(*keys, "direction").agg(*_measures(F.col("direction") == "both"))


def months(first: Column, last: Column) -> Column:
    """Length of a time span in months."""
    return (micros(last) - micros(first)) / (MONTH_SECONDS * 1e6)


def monthly_rates(totals: DataFrame, span: DataFrame, keys: list[str]) -> DataFrame:
    """Add per-month rates; ``span`` holds ``months`` per series."""
    out = join_on(totals, span, keys)
    return out.withColumns({
        "transactions_per_month": F.round(ratio(F.col("transactions").cast("double"), F.col("months")), 2),
        "profit_per_month": F.round(ratio(F.col("profit"), F.col("months")), 2),
        "profit_percent_per_month": F.round(ratio(F.col("profit_percent"), F.col("months")), 2)})


def exact_quantile(df: DataFrame, keys: list[str], column: str, q: float, name: str) -> DataFrame:
    """Exact interpolated quantile per group, from the running count of its distinct values.

    Equal values are one row before anything is sorted, however many there are.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("rows_here"))
    frame = number_rows(counted, keys, [column]).running({"rows_upto": F.col("rows_here")})
    facts = frame.df.groupBy(*keys).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("rows_here").alias("rows_all"))
    at = (F.col("rows_all") - 1) * q
    part = at - F.floor(at)

    def holds(row: Column) -> Column:
        return ((F.col("rows_upto") - F.col("rows_here") <= row) & (row < F.col("rows_upto"))).cast("double")

    weight = holds(F.floor(at)) * (1 - part) + holds(F.floor(at) + 1) * part
    return frame.attach(facts).groupBy(*keys).agg(F.sum(F.col(column) * weight).alias(name))


def recent_statistics(transactions: SeriesFrame, now: Column, weeks: int = 4, price: str = "price") -> DataFrame:
    """Per series and side over the last weeks: count, sum, mean, std, min, median and max of
    the profits in percent of the previous transaction's price."""
    frame = transactions.fill(backward={"prev_close": F.col(price)}, strict=True)
    prev = F.col("prev_close")
    percent = F.when(prev == 0, F.lit(0.0)).otherwise(ratio(F.col("profit") * 100.0, prev))
    recent = frame.df.where(
        (micros(F.col(frame.ts)) >= micros(now) - weeks * 7 * 86400 * 1_000_000) & prev.isNotNull())
    recent = recent.withColumn("profit_percent", percent)
    keys = [*frame.keys, "side"]
    stats = recent.groupBy(*keys).agg(
        F.count("profit").alias("count"), F.sum("profit").alias("profit_sum"),
        F.sum("profit_percent").alias("percent_sum"), F.avg("profit_percent").alias("percent_mean"),
        F.stddev_samp("profit_percent").alias("percent_std"), F.min("profit_percent").alias("percent_min"),
        F.max("profit_percent").alias("percent_max"))
    return join_on(stats, exact_quantile(recent, keys, "profit_percent", 0.5, "percent_median"), keys, "left")


# -- parameter sweep -------------------------------------------------------------------------


def grid_table(frame: SeriesFrame, grid: dict[str, list[float]], buy_sell_equal: bool = False) -> DataFrame:
    """All combinations of the parameter lists, one row each, with ``param_id``.

    With ``buy_sell_equal`` the sell thresholds are the negated buy thresholds.
    """
    grid = dict(grid)
    if buy_sell_equal:
        grid = {k: v for k, v in grid.items() if not k.startswith("sell_")}
    names = sorted(grid)
    points = []
    for i, values in enumerate(itertools.product(*[grid[n] for n in names])):
        point = dict(zip(names, values))
        if buy_sell_equal:
            for n in list(point):
                point[n.replace("buy_", "sell_", 1)] = -point[n]
        points.append({"param_id": i, **point})
    columns = list(points[0])
    schema = "param_id long, " + ", ".join(f"{c} double" for c in columns[1:])
    rows = [tuple([p["param_id"], *[float(p[c]) for c in columns[1:]]]) for p in points]
    return frame.df.sparkSession.createDataFrame(rows, schema)


def sweep(frame: SeriesFrame, scores: list[str], price: str, grid: dict[str, list[float]], direction: str = "",
          buy_sell_equal: bool = False, top: int | None = 10) -> DataFrame:
    """Performance of a threshold rule for every point of a parameter grid, best first.

    The rows are placed by series and bucket first and multiplied by the grid afterwards,
    so the multiplied rows need no shuffle; rows without a signal are dropped at once.
    ``scores`` names one or two columns; the grid has buy_signal_threshold and
    sell_signal_threshold (and the same with _2).  The grid is a driver-side list, hence small.
    """
    params = grid_table(frame, grid, buy_sell_equal)
    base = frame.df.select(*frame.keys, frame.ts, frame.pos, price, *scores)
    placed = base.withColumn(BUCKET, frame.home()).repartition(*frame.keys, BUCKET)
    grown = placed.crossJoin(F.broadcast(params))
    if len(scores) == 1:
        buy, sell = threshold_rule(scores[0], F.col("buy_signal_threshold"), F.col("sell_signal_threshold"))
    else:
        buy, sell = threshold_rule_two(
            *scores, (F.col("buy_signal_threshold"), F.col("buy_signal_threshold_2")),
            (F.col("sell_signal_threshold"), F.col("sell_signal_threshold_2")))
    signals = SeriesFrame(grown.withColumns({"buy": buy, "sell": sell}), ("param_id", *frame.keys), frame.ts, frame.pos,
                          frame.step_us, frame.bucket_rows)
    events = alternating_transactions(signals, "buy", "sell", price, "param_id")
    events = events.with_df(events.df.select("param_id", *frame.keys, frame.ts, frame.pos, price, "side")).settle()
    traded = transaction_profits(events, price).df
    if direction:
        if direction not in DIRECTION_SIDE:
            raise ValueError(f"direction must be long, short or empty, not {direction!r}")
        traded = traded.where(F.col("side") == DIRECTION_SIDE[direction])
    totals = traded.groupBy("param_id", *frame.keys).agg(*_measures(exact=not direction))
    span = base.groupBy(*frame.keys).agg(months(F.min(frame.ts), F.max(frame.ts)).alias("months"))
    every = span.crossJoin(F.broadcast(params))
    counted = [c for c in totals.columns if c not in ("param_id", *frame.keys)]
    measured = join_on(every, totals, ["param_id", *frame.keys], "left").fillna(0, counted)
    measured = measured.withColumns({
        "transactions_per_month": F.round(ratio(F.col("transactions").cast("double"), F.col("months")), 2),
        "profit_per_month": F.round(ratio(F.col("profit"), F.col("months")), 2),
        "profit_percent_per_month": F.round(ratio(F.col("profit_percent"), F.col("months")), 2)})
    return measured if top is None else best_parameters(measured, list(frame.keys), top)


def best_parameters(measured: DataFrame, keys: list[str], top: int, by: str = "profit_percent_per_month") -> DataFrame:
    """The best parameter sets of every series; ties go to the earlier set."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), "param_id")
    return measured.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


# -- order sizing ----------------------------------------------------------------------------

# Digits of a limit price and of an order quantity.
PRICE_DIGITS, QUANTITY_DIGITS = 2, 6


def order_price(close: Column, side: Column, adjustment: float) -> Column:
    """Limit price: a little below the close for a buy, above it for a sell, rounded as text."""
    factor = F.when(side == "BUY", F.lit(1.0 - adjustment)).otherwise(F.lit(1.0 + adjustment))
    return round_text(close * factor, PRICE_DIGITS)


def order_quantity(balance: Column, percentage: float, price: Column) -> Column:
    """Quantity that a share of the balance buys, truncated, as text."""
    amount = truncate_decimal(balance * (percentage / 100.0)).cast("decimal(28,8)")
    return round_down_text((amount / price.cast("decimal(18,2)")).cast("double"), QUANTITY_DIGITS)
