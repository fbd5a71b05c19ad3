"""The factor panel kept up to date: a load recomputes its codes from their first changed bar on.

Every row of the kept panel also holds what the rows after it need of the whole history
before them: its number, the price filled forward, the closes seen, and running sums of the
slope and its square. A load reads, of a code that changed, the few rows before the change
that rolling windows reach back to, the sums a z-score window back, and the bars from the
change on. Other codes, and earlier rows, are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.num import div
from tickloom.operators import factors as fx
from tickloom.operators.quality import between_dates
from tickloom.session import cut_lineage
from tickloom.sources import snapshots

#: What a row carries for the rows after it: number, filled price, closes seen, and of the slope the sum, the sum of squares and the count.
CARRIED = {"n": "long", "px": "double", "closes": "long", "slope": "double", "s": "double", "q": "double", "k": "long"}
BARS = ("high", "low", "close", "volume")


def _carried(name: str) -> str:
    return f"kept_{name}"


def _reach(n: int, short: int) -> int:
    """Rows before a change that the windows of the rows after it reach back to."""
    return max(2 * n - 1, short + 1)


def _extend(rows: DataFrame, base: DataFrame, old: DataFrame, columns: list[str], n: int, z: int, short: int) -> DataFrame:
    """The kept rows of the ``fresh`` ones among ``rows``.

    ``rows`` has bars in date order, some rows before the fresh ones of each code with their
    px; ``base`` what the last row before carries; ``old`` (code, n, s, q, k) of rows a
    z-score window back.
    """
    own = rows.withColumns({"__close": F.col("close"), "close": F.coalesce("close", "px")})
    own = fx.daily_return(fx.momentum(own, short)).withColumn("__px", F.last("close", ignorenulls=True).over(fx.so_far()))
    own = own.withColumn("close", F.col("__close"))
    own = fx.rolling_ols(fx.window_mean_norm(fx.volume_ratio(fx.volatility(own, short), short), n), n, 2 * n)
    own = own.filter("fresh").drop("low_norm", "high_norm", "px", "__close").withColumnRenamed("__px", "px")
    own = own.join(base.select("code", *[F.col(c).alias(f"__{c}") for c in ("n", "closes", "s", "q", "k")]), "code", "left")

    upto, v = fx.so_far(), F.col("rsrs_raw") - 1
    after = lambda c, more: F.coalesce(f"__{c}", F.lit(0)) + F.coalesce(more.over(upto), F.lit(0))
    own = own.withColumns(
        {
            "n": after("n", F.count(F.lit(1))), "closes": after("closes", F.count("close")), "slope": F.col("rsrs_raw"),
            "s": after("s", F.sum(v)), "q": after("q", F.sum(v * v)), "k": after("k", F.count(v)),
        }
    ).drop("__n", "__closes", "__s", "__q", "__k")
    sums = ["s", "q", "k"]
    back = own.select("code", "n", *sums).unionByName(old.select("code", "n", *sums))
    back = back.select("code", (F.col("n") + z).alias("n"), *[F.col(c).alias(f"__{c}") for c in sums])
    own = own.join(back, ["code", "n"], "left")
    s, q, k = (F.col(c) - F.coalesce(f"__{c}", F.lit(0)) for c in sums)
    var = div(q - s * div(s, k), k - 1)
    score = div(v - div(s, k), F.sqrt(F.greatest(var, F.lit(0.0))) + 1e-9)
    own = fx.adaptive(own.withColumn("rsrs_zscore", F.when(k >= fx.Z_MIN, score)))
    own = own.withColumns({c: F.when(F.col("closes") >= 2 * n, F.col(c)) for c in fx.RSRS_COLUMNS})
    return own.select(*columns, *[F.col(c).cast(kind).alias(_carried(c)) for c, kind in CARRIED.items()])


def _panel_columns(bars: DataFrame) -> list[str]:
    return [*bars.columns, "mom", "ret", "volatility", "vol_factor", "vol_ratio", *fx.RSRS_COLUMNS]


def kept_panel(bars: DataFrame, n: int = fx.OLS_WINDOW, z: int = fx.Z_WINDOW, short: int = fx.SHORT_WINDOW) -> DataFrame:
    """The whole panel of ``bars`` with what its rows carry; :func:`panel` is the panel alone."""
    spark = bars.sparkSession
    rows = bars.withColumns({"fresh": F.lit(True), "px": F.lit(None).cast("double")})
    kinds = ", ".join(f"{c} {kind}" for c, kind in CARRIED.items())
    none = spark.createDataFrame([], f"code {bars.schema['code'].dataType.simpleString()}, {kinds}")
    return _extend(rows, none, none, _panel_columns(bars), n, z, short)


def panel(kept: DataFrame) -> DataFrame:
    return kept.drop(*[_carried(c) for c in CARRIED])


def first_changes(loaded: DataFrame) -> DataFrame:
    """(code, first_date) of a load's rows."""
    return loaded.groupBy("code").agg(F.min("date").alias("first_date"))


def changed_rows(
    kept: DataFrame, bars: DataFrame, changes: DataFrame, n: int = fx.OLS_WINDOW, z: int = fx.Z_WINDOW, short: int = fx.SHORT_WINDOW
) -> DataFrame:
    """The rows of ``kept`` that a load changes, made anew: those of each changed code from its first change on.

    ``bars`` is the table after the load; bars are added or replaced, not taken away. A code
    that had fewer rows than a regression asks for is made from its first bar. Codes that
    are new have all their rows made.
    """
    reach = _reach(n, short)
    carried = {_carried(c): c for c in CARRIED}
    before = kept.join(changes, "code").filter(F.col("date") < F.col("first_date"))
    before = before.select("code", "date", *BARS, *carried, "first_date").withColumnsRenamed(carried)
    last = before.groupBy("code").agg(F.max_by(F.struct(*CARRIED), "date").alias("l"))
    # Rows of a short history have no slope yet, and get one when it is long enough.
    base = cut_lineage(last.select("code", "l.*").filter(F.col("n") >= 2 * n))
    starts = changes.join(base.select("code", F.col("n").alias("__last")), "code", "left")
    starts = cut_lineage(starts.withColumn("first_date", F.when(F.col("__last").isNotNull(), F.col("first_date"))))
    fresh = bars.join(starts, "code").filter(F.col("first_date").isNull() | (F.col("date") >= F.col("first_date")))
    fresh = cut_lineage(fresh.drop("first_date", "__last"))
    counts = fresh.groupBy("code").agg(F.count("*").alias("__new"))
    near = before.join(starts.select("code", "__last"), "code").filter("__last IS NOT NULL").join(counts, "code")
    # Of the history only these rows: right before the change, and a z-score window before each new row.
    context = near.filter(F.col("n") > F.col("__last") - reach)
    old = near.filter((F.col("n") > F.col("__last") - z) & (F.col("n") <= F.col("__last") - z + F.col("__new")))
    rows = context.select("code", "date", *BARS, "px", F.lit(False).alias("fresh")).unionByName(
        fresh.withColumns({"px": F.lit(None).cast("double"), "fresh": F.lit(True)}), allowMissingColumns=True
    )
    return _extend(rows, base, old, _panel_columns(bars), n, z, short)


def keep_up(bars: DataFrame, path: str, changes: DataFrame | None = None, file_rows: int = snapshots.FILE_ROWS, **windows) -> int:
    """Bring the panel stored in snapshots at ``path`` up to the bars after a load; returns its version.

    Without ``changes`` (or a panel yet) all of it is made.
    """
    spark = bars.sparkSession
    if changes is None or not snapshots.versions(spark, path):
        return snapshots.change(kept_panel(bars, **windows), path, whole_codes=True, file_rows=file_rows)
    changes = cut_lineage(changes)
    made = changed_rows(snapshots.read(spark, path), bars, changes, **windows)
    return snapshots.change(made, path, file_rows=file_rows)


def read_panel(spark, path: str, start=None, end=None) -> DataFrame:
    return between_dates(panel(snapshots.read(spark, path, start=start, end=end)), start, end)
