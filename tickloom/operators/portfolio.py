"""Portfolio analytics on tables of trades, positions, bars and equity.

Trades of one code are unbounded, so everything that runs along them goes through
:mod:`tickloom.functions.scan` over (``day``, ``part``) slices. Equity curves, calendars
and bars hold one row per day and use plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tickloom.functions.crossings import first_of_each, first_where, tree
from tickloom.functions.num import as_col, div
from tickloom.functions.scan import (
    ordered_fold,
    parted,
    running_max,
    running_sums,
    sliced,
)
from tickloom.operators.panel import asof_join
from tickloom.session import cut_lineage

# Cost model and limits.
COMMISSION_RATE = 0.0003
MIN_COMMISSION = 5.0
STAMP_TAX = 0.001
SLIPPAGE = 0.001
LIVE_SLIPPAGE = 0.0005
LOT = 100
MAX_POSITION = 0.10
MAX_INDUSTRY = 0.30
MAX_POSITIONS = 10
STOP_LOSS, TAKE_PROFIT, TRAILING = 0.10, 0.20, 0.05
LIVE_STOP_LOSS, LIVE_TAKE_PROFIT, LIVE_TRAILING = 0.08, 0.20, 0.05
SUSPENSION_DISCOUNT = 0.98
MAX_DRAWDOWN, COOLDOWN_DAYS = 0.20, 5
YEAR = 252
RISK_FREE = 0.03
TINY = 1e-9

# Trades per slice, on average, when a code's buys and sells are laid side by side.
MATCH_TRADES = 10_000
BARE_SLICES = 1 << 16
# Natural logarithm of how far holdings shrink before average costs are scaled anew.
SCALE = 300.0
# Closes per block of a watermark.
BLOCK = 64
# A day beyond all days.
NEVER = (1 << 31) - 1
# Bars are numbered below this; a multiple of all block sizes, less one.
LAST_BAR = (1 << 36) - 1


# ---------------------------------------------------------------- costs and sizing


def is_buy(side="side") -> Column:
    return as_col(side) == "BUY"


def execution_price(price, side="side", slippage: float = SLIPPAGE) -> Column:
    p = as_col(price)
    return F.when(is_buy(side), p * (1 + slippage)).otherwise(p * (1 - slippage))


def commission(amount, rate: float = COMMISSION_RATE, least: float = MIN_COMMISSION) -> Column:
    return F.greatest(F.lit(least), as_col(amount) * rate)


def stamp_tax(amount, side="side", rate: float = STAMP_TAX) -> Column:
    return F.when(is_buy(side), 0.0).otherwise(as_col(amount) * rate)


def with_costs(trades: DataFrame, slippage: float = SLIPPAGE) -> DataFrame:
    """Adds exec_price, amount, commission, tax and net (paid for buys, received for sells)."""
    out = trades.withColumn("exec_price", execution_price("price", "side", slippage))
    out = out.withColumn("amount", F.col("exec_price") * F.col("qty"))
    out = out.withColumns({"commission": commission("amount"), "tax": stamp_tax("amount")})
    fees = F.col("commission") + F.col("tax")
    return out.withColumn("net", F.when(is_buy(), F.col("amount") + fees).otherwise(F.col("amount") - fees))


def buy_lots(weight, total_value, cash, price, cap: float = MAX_POSITION) -> Column:
    """Shares in whole lots that a weight buys, limited by cap and cash."""
    w, p = as_col(weight), as_col(price)
    budget = F.least(F.least(w, F.lit(cap)) * as_col(total_value), as_col(cash))
    return F.when(budget < p * LOT, 0).otherwise(F.floor(div(budget, p) / LOT) * LOT)


def live_lots(cash, price, cap: float = MAX_POSITION, slippage: float = LIVE_SLIPPAGE) -> Column:
    return F.floor(div(as_col(cash) * cap, as_col(price) * (1 + slippage)) / LOT) * LOT


# ---------------------------------------------------------------- lots


def booked(
    trades: DataFrame, levels: Sequence[str], order: Sequence[str], keys: Sequence[str] = ("code",)
) -> DataFrame:
    """Adds per trade what is held after it and how much of a sell was covered.

    Sells may exceed holdings; what they exceed them by is the depth of the running
    sum below zero, so everything follows from one scan.
    """
    t, cuts, along = sliced(trades, keys, levels, order)
    return _booked(t, cuts, along, keys).drop(*cuts)


def _booked(trades: DataFrame, levels: Sequence[str], order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    buy = F.when(is_buy(), F.col("qty")).otherwise(0.0)
    sell = F.when(is_buy(), 0.0).otherwise(F.col("qty"))
    t = trades.withColumns({"buy": buy, "sell": sell, "signed": buy - sell})
    run = running_sums(t, list(keys), levels, order, ["buy", "sell", "signed"], low_of="signed")
    zero = F.lit(0.0)
    short, short_before = F.least("low", zero), F.coalesce(F.least("low_before", zero), zero)
    return run.withColumns(
        {
            "held": F.col("run_signed") - short,
            "covered": F.when(is_buy(), zero).otherwise(F.col("qty") - (short_before - short)),
            "sold_upto": F.col("run_sell") + short,
        }
    ).drop("low", "low_before", "run_signed", "run_sell", "buy", "sell", "signed")


def fifo_pnl(
    trades: DataFrame, levels: Sequence[str], order: Sequence[str], ids: Sequence[str],
    per_slice: int = MATCH_TRADES,
) -> DataFrame:
    """Realised profit of every sell against the oldest lots: (code, ids, covered, pnl, win).

    Buys tile the axis of bought quantity and covered sells the same axis, so each
    stretch between two neighbouring boundaries belongs to one buy and one sell. The
    axis of a code is cut into equal slices of ``per_slice`` trades or a little more on average,
    whatever the quantities; a slice is swept once in order and no pairs of trades are formed.
    """
    b = cut_lineage(booked(trades, levels, order))
    sizes = b.groupBy("code").agg(F.count("*").alias("__count"), F.max("run_buy").alias("__total"))
    slices = F.ceil(F.col("__count") / F.lit(per_slice))
    # A power of two, so that cutting quantities at its multiples does not round them.
    exact = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("__total") / slices, F.lit(TINY)))))
    sizes = sizes.select("code", exact.alias("__span"))
    b, span = b.join(sizes, "code"), F.col("__span")
    laid = b.select(
        "code", *ids, "__span", F.col("price"), is_buy().alias("is_buy"),
        F.when(is_buy(), F.col("run_buy") - F.col("qty")).otherwise(F.col("sold_upto") - F.col("covered")).alias("lo"),
        F.when(is_buy(), F.col("run_buy")).otherwise(F.col("sold_upto")).alias("hi"),
    )
    first = F.floor(F.col("lo") / span)
    # A sell covered by nothing takes part in no slice; any number of them may sit at one
    # place of the axis, so they are spread over slices of their own.
    bare = F.col("hi") <= F.col("lo")
    aside = -1 - F.pmod(F.xxhash64(*ids), F.lit(BARE_SLICES))
    inside = F.sequence(first, F.greatest(first, F.ceil(F.col("hi") / span) - 1))
    pieces = laid.filter("hi > lo OR NOT is_buy").withColumn(
        "__k", F.explode(F.when(bare, F.array(aside)).otherwise(inside))
    )
    pieces = pieces.withColumns(
        {
            "lo": F.when(bare, F.col("lo")).otherwise(F.greatest("lo", F.col("__k") * span)),
            "hi": F.when(bare, F.col("lo")).otherwise(F.least("hi", (F.col("__k") + 1) * span)),
        }
    )
    along = Window.partitionBy("code", "__k").orderBy("lo", F.col("is_buy").desc())
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    lot = F.struct("hi", "price", *ids)
    swept = pieces.withColumns(
        {
            "__b": F.last(F.when(F.col("is_buy"), lot), ignorenulls=True).over(upto),
            "__s": F.last(F.when(~F.col("is_buy"), lot), ignorenulls=True).over(upto),
            "__next": F.lead("lo").over(along),
        }
    )
    size = F.least(F.col("__next"), F.col("__b.hi"), F.col("__s.hi")) - F.col("lo")
    both = F.col("__b").isNotNull() & F.col("__s").isNotNull()
    matched = swept.withColumn("__n", F.when(both, F.greatest(size, F.lit(0.0))).otherwise(0.0))
    parts = matched.filter("__n > 0 OR NOT is_buy").select(
        "code", *[F.col(f"__s.{i}").alias(i) for i in ids], F.col("__n").alias("covered"),
        F.when(F.col("__n") > 0, F.col("__n") * (F.col("__s.price") - F.col("__b.price"))).otherwise(0.0).alias("pnl"),
    )
    out = parts.groupBy("code", *ids).agg(F.sum("covered").alias("covered"), F.sum("pnl").alias("pnl"))
    return out.withColumn("win", F.signum("pnl"))


def average_cost(trades: DataFrame, levels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``held`` and the moving average cost ``avg_cost`` after each trade.

    What is held costs, after trade t, the sum over buys s up to t of price * qty * D_t / D_s,
    where D is the product of held / held before over sells since nothing was held. ln D is
    a running sum, and so is the rest, scaled anew in every stretch over which D falls by
    ``SCALE``; of what was bought before a stretch, only the stretch just before it still
    counts in double precision. A sell leaves the cost as it is, down to nothing held.
    """
    whole, cut, levels, along = parted(trades, ["code"], levels, order)
    columns = [*trades.columns, "held", "covered", "avg_cost"]
    in_slices = _cost_in_slices(cut, levels, along).select(*columns)
    return _cost_of_whole(whole, along).select(*columns).unionByName(in_slices)


def _shrinking(booked: DataFrame) -> DataFrame:
    """Adds what was held before a trade, whether the trade sells all of it, and ln of how far it shrinks."""
    before = F.col("held") + F.when(is_buy(), -F.col("qty")).otherwise(F.col("covered"))
    gone = ~is_buy() & (F.col("held") <= 0) & (before > 0)
    shrunk = F.when(~is_buy() & ~gone & (before > 0), F.log(F.col("held") / before)).otherwise(0.0)
    return booked.withColumns({"__gone": gone.cast("long"), "__ln": shrunk, "__was": before})


def _stretches(summed: DataFrame) -> DataFrame:
    """Adds the life and the stretch a trade is in, D on the stretch's scale, and what was paid on it."""
    start = F.floor(-F.col("run___ln") / F.lit(SCALE))
    b = summed.withColumn("__life", F.col("run___gone") - F.col("__gone"))
    b = b.withColumns({"__part": start, "__scale": F.exp(F.col("run___ln") + start * F.lit(SCALE))})
    return b.withColumn("__paid", F.when(is_buy(), F.col("price") * F.col("qty") / F.col("__scale")).otherwise(0.0))


def _basis() -> Column:
    """What is held cost: what was paid in this stretch and what is left of the one before."""
    carried = F.coalesce(F.col("__old") * F.exp(F.col("run___ln") - F.col("__old_ln")), F.lit(0.0))
    return F.col("__scale") * F.col("run___paid") + carried


def _priced() -> Column:
    """A trade that sells everything is priced as held before it."""
    gone = F.col("__gone") > 0
    return F.coalesce(div(_basis(), F.when(gone, F.col("__was")).otherwise(F.col("held"))), F.lit(0.0))


def _idle() -> Column:
    """Sells of nothing repeat the cost before them: it is the cost at the end of the last life."""
    return ~is_buy() & (F.col("__was") <= 0)


def _cost_of_whole(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """Average cost of codes that one task takes whole: windows only, one exchange by code and two sorts.

    Life and stretch never fall along a code's trades, so that an order that begins with them is the same one.
    """
    b = _shrinking(_booked(trades, [], order, ["code"])).drop("run_buy", "sold_upto")
    b = _stretches(running_sums(b, ["code"], [], order, ["__gone", "__ln"]))
    b = running_sums(b, ["code", "__life", "__part"], [], order, ["__paid"]).drop("__paid")
    life = Window.partitionBy("code", "__life").orderBy("__part", *order)
    code = Window.partitionBy("code").orderBy("__life", "__part", *order)
    before = Window.unboundedPreceding, -1
    end = F.struct((F.col("__scale") * F.col("run___paid")).alias("paid"), F.col("run___ln").alias("ln"))
    ends = F.coalesce(F.lead("__part").over(life) > F.col("__part"), F.lit(False))
    b = b.withColumn("__end", F.when(ends, end))
    b = b.withColumn("__old", F.last("__end", ignorenulls=True).over(life.rowsBetween(*before)))
    b = b.withColumns({"__old": F.col("__old.paid"), "__old_ln": F.col("__old.ln")})
    b = b.withColumn("__closing", F.when(F.col("__gone") > 0, div(_basis(), "__was")))
    b = b.withColumn("__closing", F.last("__closing", ignorenulls=True).over(code.rowsBetween(*before)))
    return b.withColumn("avg_cost", F.when(_idle(), F.coalesce("__closing", F.lit(0.0))).otherwise(_priced()))


def _cost_in_slices(trades: DataFrame, levels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Average cost of codes cut by ``levels``."""
    # The first two scans run over the same slices in the same order, so that they share an exchange.
    b = _shrinking(_booked(trades, levels, order, ["code"])).drop("run_buy")
    # Both sums at once; a stretch starts anew after everything was sold.
    b = _stretches(cut_lineage(running_sums(b, ["code"], levels, order, ["__gone", "__ln"])))
    group = ["code", "__life", "__part"]
    b = cut_lineage(running_sums(b, group, levels, order, ["__paid"]))
    # ln D never rises, so the least of a stretch is that at its end.
    ends = b.groupBy(*group).agg((F.min("__scale") * F.sum("__paid")).alias("__end"), F.min("run___ln").alias("__end_ln"))
    w = Window.partitionBy("code", "__life").orderBy("__part")
    ends = ends.select(*group, F.lag("__end").over(w).alias("__old"), F.lag("__end_ln").over(w).alias("__old_ln"))
    b = b.join(ends, group)
    closing = b.filter("__gone > 0").select(
        "code", (F.col("__life") + 1).alias("__life"), div(_basis(), "__was").alias("__closing")
    )
    out = b.withColumn("avg_cost", _priced()).join(closing, ["code", "__life"], "left")
    return out.withColumn("avg_cost", F.when(_idle(), F.coalesce("__closing", F.lit(0.0))).otherwise(F.col("avg_cost")))


# ---------------------------------------------------------------- valuation


def mark_to_market(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds close, market_value, pnl and pnl_pct at the latest close up to each date."""
    out = asof_join(positions, bars, ["close"])
    out = out.withColumn("market_value", F.col("qty") * F.col("close"))
    basis = F.col("cost") * F.col("qty")
    return out.withColumns(
        {
            "pnl": F.col("market_value") - basis,
            "pnl_pct": F.when(basis > TINY, div(F.col("market_value") - basis, basis)).otherwise(0.0),
        }
    )


def total_market_value(marked: DataFrame, suspended: DataFrame, discount: float = SUSPENSION_DISCOUNT) -> DataFrame:
    """Per date; positions in suspended codes count at a discount."""
    off = suspended.select("date", "code").distinct().withColumn("__off", F.lit(True))
    mv = F.when(F.col("__off"), F.col("market_value") * discount).otherwise(F.col("market_value"))
    return marked.join(off, ["date", "code"], "left").groupBy("date").agg(F.sum(mv).alias("market_value"))


def _blocks(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closes in blocks of ``BLOCK`` per code: (code, __b, __path), and per code ``__walk``, its blocks' figures.

    A block's figures are its first and last date, low, high and worst fall from a close to
    a later one.
    """
    closes = bars.filter("close > 0").select("code", "date", "close")
    place = F.row_number().over(Window.partitionBy("code").orderBy("date")) - 1
    closes = closes.withColumn("__b", F.floor(place / BLOCK).cast("int"))
    high = F.max("close").over(Window.partitionBy("code", "__b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    blocks = closes.withColumn("__fall", 1 - F.col("close") / high).groupBy("code", "__b").agg(
        F.sort_array(F.collect_list(F.struct("date", "close"))).alias("__path"),
        F.min("close").alias("lo"), F.max("close").alias("hi"), F.max("__fall").alias("fall"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )
    walks = blocks.groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("__b", "first", "last", "lo", "hi", "fall"))).alias("__walk")
    )
    return blocks.select("code", "__b", "__path"), walks


def watermarks(entries: DataFrame, bars: DataFrame, until: Column | None = None) -> DataFrame:
    """Adds the highest of the entry price and all closes after the entry day, up to ``until``.

    Blocks of closes that lie whole in that time count by their high; the two at its ends
    are opened.
    """
    blocks, walks = _blocks(bars)
    end = F.lit(None).cast("date") if until is None else until
    cases = entries.select("code", "entry_date", end.alias("__until")).distinct().join(walks, "code")
    upto = F.coalesce("__until", F.lit("9999-12-31").cast("date"))
    touched = F.filter("__walk", lambda x: (x["last"] > F.col("entry_date")) & (x["first"] <= upto))

    def inside(x):
        return (x["first"] > F.col("entry_date")) & (x["last"] <= upto)

    high = F.array_max(F.transform(F.filter(touched, inside), lambda x: x["hi"]))
    ends = F.transform(F.filter(touched, lambda x: ~inside(x)), lambda x: x["__b"])
    keys = ["code", "entry_date", "__until"]
    cases = cases.select(*keys, high.alias("__high"), F.explode_outer(ends).alias("__b"))
    held = F.filter("__path", lambda x: (x["date"] > F.col("entry_date")) & (x["date"] <= upto))
    opened = cases.join(blocks, ["code", "__b"], "left").withColumn("__top", F.array_max(F.transform(held, lambda x: x["close"])))
    best = opened.groupBy(*keys).agg(F.greatest(F.max("__high"), F.max("__top")).alias("__best"))
    out = entries.withColumn("__until", end)
    same = [out[k].eqNullSafe(best[k]) for k in keys]
    out = out.join(best, same[0] & same[1] & same[2], "left").select(*[out[c] for c in entries.columns], "__best")
    return out.withColumn("watermark", F.greatest("cost", "__best")).drop("__best")


def exit_event(cost, price, watermark, stop, take, trail, live: bool = False) -> Column:
    """stop_loss, take_profit or trailing_stop, in that order; NULL for none.

    A trailing stop needs the watermark above cost; in live form it only needs a watermark.
    """
    c, p, w = as_col(cost), as_col(price), as_col(watermark)
    pnl = F.when(c > TINY, div(p - c, c))
    armed = (w > 0) if live else (w > c)
    return (
        F.when(pnl <= -stop, "stop_loss")
        .when(pnl >= take, "take_profit")
        .when(armed & pnl.isNotNull() & (div(w - p, w) >= trail), "trailing_stop")
    )


def _numbered(bars: DataFrame) -> DataFrame:
    """(code, date, idx, close) of positive closes, numbered from 0 by date within a code."""
    place = F.row_number().over(Window.partitionBy("code").orderBy("date")) - 1
    return bars.filter("close > 0").select("code", "date", place.cast("long").alias("idx"), "close")


def _fall(top, price) -> Column:
    return div(as_col(top) - as_col(price), top)


def trailing_exits(closes: DataFrame, trail: float) -> DataFrame:
    """(code, idx, out): the first bar that lies ``trail`` below the highest close from bar idx on; null for none.

    Bar j is an exit for all bars up to the last one before it that j lies ``trail`` below. So
    that one is searched for every j, backwards, and the earliest j at or after each bar is
    a running minimum.
    """
    back = lambda idx: F.lit(LAST_BAR) - idx
    mirrored = tree(closes.select("code", back(F.col("idx")).alias("idx"), F.col("close").alias("x")), "code")
    asked = closes.select("code", "idx", F.col("close").alias("price"), (back(F.col("idx")) + 1).alias("start"))
    last = first_where(asked, mirrored, "code", ["code", "idx"], lambda lo, hi: _fall(hi, "price") >= trail)
    from_top = last.groupBy("code", back(F.col("found")).alias("idx")).agg(F.min("idx").alias("__exit"))
    later = Window.partitionBy("code").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    marked = closes.select("code", "idx").join(from_top, ["code", "idx"], "left")
    return marked.select("code", "idx", F.min("__exit").over(later).alias("out"))


def exit_scan(
    entries: DataFrame, bars: DataFrame, stop: float = STOP_LOSS, take: float = TAKE_PROFIT,
    trail: float = TRAILING, min_holding_bars: int = 1,
) -> DataFrame:
    """First close at which each entry (code, entry_date, cost) meets an exit rule.

    The watermark starts at the cost and follows every close after the entry day; an exit is
    allowed from the ``min_holding_bars``-th bar after it, with 0 on the entry day itself.

    No entry walks its closes. A stop, a target, and the first close above the watermark are
    first crossings of a price, found in a tree of blocks. What a trailing stop does from that
    close on does not depend on the entry; it is known per bar. One watermark is still open at
    the first bar an exit is allowed at: the highest close so far, and falls from it are a
    crossing too.
    """
    n = max(1, min_holding_bars)
    upto = Window.partitionBy("code").orderBy("date").rowsBetween(1 - n, 0)
    numbered = cut_lineage(_numbered(bars).withColumn("top", F.max("close").over(upto)))
    closes = numbered.select("code", "date", "idx", "close")
    levels = tree(closes.select("code", "idx", F.col("close").alias("x")), "code")

    # The last bar up to each entry day.
    marks = numbered.select("code", "date", "idx").unionByName(
        entries.select("code", F.col("entry_date").alias("date")).distinct().withColumn("idx", F.lit(None).cast("long"))
    )
    upto = Window.partitionBy("code").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    known = marks.withColumn("__last", F.max("idx").over(upto)).filter("idx IS NULL")
    known = known.select("code", F.col("date").alias("entry_date"), F.coalesce("__last", F.lit(-1)).alias("__last"))
    keys = ["code", "entry_date", "cost"]
    cases = entries.select(*keys).distinct().join(known, ["code", "entry_date"]).filter(F.col("cost") > TINY)
    first = numbered.select("code", F.col("idx").alias("__first"), "top")
    cases = cases.withColumn("__first", F.col("__last") + n).join(first, ["code", "__first"])
    cases = cases.select(*keys, "top", F.greatest("top", "cost").alias("open"), F.col("__first").alias("start"))

    change = lambda price: div(price - F.col("cost"), "cost")
    # The watermark holds the first close, so that none of these is met before the first bar.
    rules = {
        "stop_loss": lambda lo, hi: change(lo) <= -stop,
        "take_profit": lambda lo, hi: change(hi) >= take,
        "opened": lambda lo, hi: (F.col("top") > F.col("cost")) & (_fall("open", lo) >= trail),
        "above": lambda lo, hi: hi > F.col("open"),
    }
    final = ["stop_loss", "take_profit", "opened"]
    found = first_of_each(cases, levels, "code", rules, final).select(*keys, *rules)
    trailed = trailing_exits(closes, trail).select("code", F.col("idx").alias("above"), "out")
    # A rise above the watermark counts if it comes before the other exits.
    rising = F.coalesce(F.col("above") < F.least(*final, F.lit(LAST_BAR + 1)), F.lit(False))
    risen = found.filter(rising).join(trailed, ["code", "above"], "left")
    found = risen.unionByName(found.filter(~rising).withColumn("out", F.lit(None).cast("long")))
    # Of rules met at one close the first in this order counts.
    met = lambda at, order: F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("found"), F.lit(order).alias("order")))
    hit = F.array_min(F.array(met("stop_loss", 0), met("take_profit", 1), met("opened", 2), met("out", 2)))
    best = found.select(*keys, hit.alias("__hit")).filter("__hit IS NOT NULL")
    if min_holding_bars == 0:
        # The entry day's own close, against the cost alone.
        own = closes.select("code", F.col("date").alias("entry_date"), F.col("idx").alias("found"), "close")
        own = entries.select(*keys).distinct().filter(F.col("cost") > TINY).join(own, ["code", "entry_date"])
        order = F.when(change(F.col("close")) <= -stop, 0).when(change(F.col("close")) >= take, 1)
        own = own.select(*keys, "found", order.alias("order")).filter("order IS NOT NULL").select(*keys, F.struct("found", "order").alias("__hit"))
        best = best.unionByName(own).groupBy(*keys).agg(F.min("__hit").alias("__hit"))
    event = F.element_at(F.array(*[F.lit(x) for x in ("stop_loss", "take_profit", "trailing_stop")]), F.col("__hit.order") + 1)
    best = best.select(*keys, F.col("__hit.found").alias("idx"), event.alias("exit_event"))
    dated = best.join(closes, ["code", "idx"]).select(*keys, "exit_event", F.col("date").alias("exit_date"), F.col("close").alias("exit_price"))
    return entries.join(dated, keys, "left").select(*entries.columns, "exit_event", "exit_date", "exit_price")


def live_exits(
    positions: DataFrame, quotes: DataFrame, levels: Sequence[str], order: Sequence[str],
    stop: float = LIVE_STOP_LOSS, take: float = LIVE_TAKE_PROFIT, trail: float = LIVE_TRAILING,
) -> DataFrame:
    """Every quote of a held code that meets an exit rule, with the watermark up to that quote."""
    held = positions.select("code", "cost", F.col("watermark").alias("__wm"))
    ticks = quotes.join(held, "code")
    high = running_max(ticks, ["code"], levels, order, "price", "__high")
    out = high.withColumn("watermark", F.greatest("__wm", "__high"))
    out = out.withColumn("event", exit_event("cost", "price", "watermark", stop, take, trail, live=True))
    return out.filter("event IS NOT NULL").withColumn("pnl_pct", div(F.col("price") - F.col("cost"), "cost")).drop(
        "__wm", "__high"
    )


def equity_curve(
    booked_trades: DataFrame, bars: DataFrame, initial_cash: float, slippage: float = SLIPPAGE, by: Sequence[str] = ()
) -> DataFrame:
    """(by, date, cash, market_value, total_value) on every date with a bar.

    With ``by`` there is one curve per group, on the dates with a bar of a code it traded.

    Costs are those of what was traded: of a sell, what was covered, and nothing for a sell
    of nothing. Trades are reduced to one row per code and date; market value is the running
    sum over dates of each code's change in held times close, so that work follows the rows
    and not codes times dates. Needs ``date``, the calendar date a trade belongs to.
    """
    done = booked_trades.withColumn("qty", F.when(is_buy(), F.col("qty")).otherwise(F.col("covered")))
    done = with_costs(done, slippage)
    paid = F.when(is_buy(), -F.col("net")).when(F.col("qty") > 0, F.col("net")).otherwise(0.0)
    days = done.groupBy(*by, "code", "date").agg(F.sum(paid).alias("flow"), F.max_by("held", "seq").alias("held"))
    shown = bars.select("code", "date", "close", F.lit(True).alias("bar"))
    if by:
        shown = shown.join(booked_trades.select(*by, "code").distinct(), "code")
    points = shown.join(days, [*by, "code", "date"], "full")
    along = Window.partitionBy(*by, "code").orderBy("date")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.last("held", ignorenulls=True).over(upto) * F.last("close", ignorenulls=True).over(upto), F.lit(0.0))
    points = points.withColumn("value", value)
    points = points.withColumn("change", F.col("value") - F.coalesce(F.lag("value").over(along), F.lit(0.0)))
    dates = points.groupBy(*by, "date").agg(
        F.coalesce(F.sum("flow"), F.lit(0.0)).alias("flow"), F.sum("change").alias("change"), F.max("bar").alias("bar")
    )
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = dates.select(
        *by, "date", "bar", (F.lit(initial_cash) + F.sum("flow").over(w)).alias("cash"), F.sum("change").over(w).alias("market_value")
    )
    return curve.filter("bar").drop("bar").withColumn("total_value", F.col("cash") + F.col("market_value"))


# ---------------------------------------------------------------- performance


def drawdowns(equity: DataFrame, key: str = "portfolio") -> DataFrame:
    """Adds peak, drawdown and the deepest drawdown so far. One row per day per portfolio."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = equity.withColumn("peak", F.max("total_value").over(w))
    dd = F.when(F.col("peak") > TINY, div(F.col("peak") - F.col("total_value"), "peak")).otherwise(0.0)
    return out.withColumn("drawdown", dd).withColumn("max_drawdown", F.max("drawdown").over(w))


def performance(equity: DataFrame, initial_cash: Column | None = None, key: str = "portfolio") -> DataFrame:
    """Return, risk and ratio figures per portfolio; fewer than two rows give none.

    ``initial_cash`` defaults to the first value. An unbounded Sortino ratio is infinity.
    """
    w = Window.partitionBy(key).orderBy("ts")
    rows = drawdowns(equity, key).withColumn(
        "ret", div(F.col("total_value"), F.lag("total_value").over(w)) - 1
    )
    excess = F.col("ret") - RISK_FREE / YEAR
    first = F.min_by("total_value", "ts") if initial_cash is None else F.first(initial_cash)
    agg = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        first.alias("start"),
        F.max_by("total_value", "ts").alias("end"),
        (F.stddev_pop("ret") * YEAR**0.5).alias("volatility"),
        (F.stddev_pop(F.when(excess < 0, excess)) * YEAR**0.5).alias("__down"),
        F.count_if(excess < 0).alias("__bad"),
        F.max("drawdown").alias("max_drawdown"),
    ).filter("n >= 2")
    growth = div("end", "start")
    annual = F.pow(growth, F.lit(float(YEAR)) / (F.col("n") - 1)) - 1
    inf = F.lit(float("inf"))
    return agg.select(
        key,
        "n",
        (growth - 1).alias("total_return"),
        annual.alias("annual_return"),
        "volatility",
        F.when(F.col("volatility") > TINY, div(annual, "volatility")).otherwise(0.0).alias("sharpe_ratio"),
        F.when(F.col("__bad") == 0, inf)
        .when(F.col("__down") > TINY, div(annual, "__down"))
        .otherwise(inf).alias("sortino_ratio"),
        "max_drawdown",
        F.when(F.col("max_drawdown") != 0, div(annual, "max_drawdown")).alias("calmar_ratio"),
    )


def trade_quality(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Win rate and mean profit over mean loss from realised results; break-even wins."""
    win, loss = F.col("pnl") >= 0, F.col("pnl") < 0
    out = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.coalesce(F.avg(win.cast("int")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(loss, -F.col("pnl"))), F.lit(0.0)).alias("avg_loss"),
    )
    none = F.when(F.col("avg_win") > 0, float("inf")).otherwise(0.0)
    ratio = F.when(F.col("avg_loss") == 0, none).otherwise(div("avg_win", "avg_loss"))
    return out.withColumn("profit_loss_ratio", ratio)


def circuit_breaker(
    equity: DataFrame, limit: float = MAX_DRAWDOWN, cooldown: int = COOLDOWN_DAYS, key: str = "portfolio"
) -> DataFrame:
    """Adds ``broken``: on when the drawdown reaches the limit, off after the cool-down.

    The state on a day rests on the values before it, two at least; a portfolio has one row
    per day. Where a switch ends is known for every day that could start one: the first
    row a cool-down later. Which of these days do start one depends on the one before only, so the
    days at the limit, a few of a portfolio's, are passed once in order; the state follows by a window.
    """
    along = Window.partitionBy(key).orderBy("ts")
    rows = drawdowns(equity, key).withColumns(
        {"__day": F.unix_date("ts"), "__last": F.lag("drawdown").over(along), "__place": F.row_number().over(along)}
    )
    # Backwards in time, all that lies a cool-down ahead comes first.
    ahead = Window.partitionBy(key).orderBy(F.col("__back")).rangeBetween(Window.unboundedPreceding, -max(cooldown, 1))
    rows = rows.withColumn("__back", -F.col("__day")).withColumn("__until", F.coalesce(F.min("__day").over(ahead), F.lit(NEVER)))
    start = (F.col("__place") >= 3) & (F.col("__last") >= limit)

    def pick(state, at):
        on = F.struct(
            F.concat(state["days"], F.array(at["__day"])).alias("days"), at["__until"].alias("off")
        )
        return F.when(at["__day"] > state["off"], on).otherwise(state)

    none = F.struct(F.array().cast("array<int>").alias("days"), F.lit(-NEVER).alias("off"))
    days = F.array_sort(F.collect_list(F.struct("__day", "__until")))
    starts = rows.filter(start).groupBy(key).agg(F.aggregate(days, none, pick, lambda s: s["days"]).alias("__days"))
    starts = starts.select(key, F.explode("__days").alias("__day"), F.lit(True).alias("__on"))
    ends = F.last(F.when(F.col("__on"), F.col("__until")), ignorenulls=True).over(along)
    out = rows.join(starts, [key, "__day"], "left").withColumn("broken", F.coalesce(F.col("__day") < ends, F.lit(False)))
    return out.select(*equity.columns, "peak", "drawdown", "max_drawdown", "broken")


# ---------------------------------------------------------------- limits


def cap_positions(signals: DataFrame, cap: float = MAX_POSITION, by: str = "date") -> DataFrame:
    """Scale a date's buy weights to sum to at most 1, then drop buys above the cap."""
    total = signals.filter(is_buy()).groupBy(by).agg(F.sum("weight").alias("__sum"))
    out = signals.join(total, by, "left")
    scaled = F.when(is_buy() & (F.col("__sum") > 1.0), div("weight", "__sum")).otherwise(F.col("weight"))
    out = out.withColumn("weight", scaled).drop("__sum")
    return out.filter(~is_buy() | (F.col("weight") <= cap))


def cap_industries(
    signals: DataFrame, industry: DataFrame, exposure: DataFrame | None = None,
    order: Sequence[str] = ("rank",), cap: float = MAX_INDUSTRY,
) -> DataFrame:
    """Accept buys in order while their industry's exposure stays within the cap.

    A rejected buy uses no budget, so this is a fold and not a running sum. It runs
    over one date's buys in one industry, which the strategies' top-n bounds; buys
    that exceed the cap even on the starting exposure are dropped before the fold.
    """
    tagged = signals.join(industry.select("code", "sector_name"), "code", "left").withColumn(
        "sector_name", F.coalesce("sector_name", F.lit("unknown"))
    )
    if exposure is not None:
        tagged = tagged.join(exposure.select("date", "sector_name", "exposure"), ["date", "sector_name"], "left")
    else:
        tagged = tagged.withColumn("exposure", F.lit(0.0))
    tagged = tagged.withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))
    buys = tagged.filter(is_buy() & (F.col("exposure") + F.col("weight") <= cap))

    def step(used, row):
        wanted = used + row[1]
        return (wanted, (True,)) if wanted <= cap else (used, (False,))

    kept = ordered_fold(
        buys, ["date", "sector_name"], list(order), StructType([StructField("__ok", BooleanType())]),
        lambda row: row[0], step, reads=["exposure", "weight"],
    ).filter("__ok").drop("__ok")
    return kept.unionByName(tagged.filter(~is_buy()))


def admit(buys: DataFrame, positions: DataFrame, limit: int = MAX_POSITIONS) -> DataFrame:
    """Buys, best first, while a date's held codes and new ones number at most ``limit``.

    More of a held code is always admitted and takes no place.
    """
    count = positions.groupBy("date").agg(F.count_distinct("code").alias("__held"))
    mine = positions.select("date", "code").distinct().withColumn("__mine", F.lit(True))
    tagged = buys.join(mine, ["date", "code"], "left").withColumn("__mine", F.coalesce("__mine", F.lit(False)))
    w = Window.partitionBy("date").orderBy(F.col("score").desc(), "code")
    fresh = tagged.filter("NOT __mine").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit)
    fresh = fresh.join(count, "date", "left").filter(
        F.col("__n") + F.coalesce("__held", F.lit(0)) <= limit
    ).drop("__n", "__held")
    return fresh.unionByName(tagged.filter("__mine")).drop("__mine")


def account_summary(positions: DataFrame, cash: float, initial: float, by: Sequence[str] = ("date",)) -> DataFrame:
    """Needs ``market_value`` per position."""
    mv = F.coalesce(F.sum("market_value"), F.lit(0.0))
    out = positions.groupBy(*by).agg(mv.alias("market_value"), F.count(F.lit(1)).alias("position_count"))
    total = F.lit(cash) + F.col("market_value")
    return out.withColumns(
        {
            "cash": F.lit(cash),
            "total_assets": total,
            "pnl": total - initial,
            "pnl_pct": (total - initial) / initial,
        }
    )


def live_sell_pnl(costed: DataFrame) -> DataFrame:
    """Net proceeds of each covered sell minus its average cost. Needs ``avg_cost`` and ``covered``."""
    sells = costed.filter(~is_buy()).filter("covered > 0").withColumn("qty", F.col("covered"))
    out = with_costs(sells, LIVE_SLIPPAGE)
    return out.withColumn("pnl", F.col("net") - F.col("avg_cost") * F.col("qty"))


def daily_loss(sells: DataFrame) -> DataFrame:
    """Losses only, summed per day."""
    return sells.groupBy("day").agg(F.sum(F.least("pnl", F.lit(0.0))).alias("daily_loss"))


