"""Multi-source merges and incremental upserts.

Choosing one of several rows of a key is always an aggregate (``max_by``), never a
window: copies of one key are reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import quality as q
from tickloom.schemas import EXTENSION_COLUMNS
from tickloom.session import cut_lineage


def _pick(df: DataFrame, keys: Sequence[str], rank: Sequence[str | Column], drop: Sequence[str] = ()) -> DataFrame:
    """Per key the row with the highest rank."""
    values = [c for c in df.columns if c not in keys and c not in drop]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*rank)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in values])


def merge_dual(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary prices with the secondary's extension columns; codes the primary lacks
    altogether come from the secondary as they are."""
    ext = [c for c in EXTENSION_COLUMNS if c in secondary.columns]
    enriched = primary.drop(*ext).join(secondary.select("code", "date", *ext), ["code", "date"], "left")
    whole = secondary.join(primary.select("code").distinct(), "code", "left_anti")
    both = enriched.withColumn("origin", F.lit("primary")).unionByName(
        whole.withColumn("origin", F.lit("secondary")), allowMissingColumns=True
    )
    return both


def first_source(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Per code all rows of the first source, in the given order, that has any; tagged ``source``."""
    tagged = None
    for rank, (name, df) in enumerate(sources.items()):
        one = df.withColumns({"source": F.lit(name), "__rank": F.lit(rank)})
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    best = tagged.groupBy("code").agg(F.min("__rank").alias("__rank"))
    return tagged.join(best, ["code", "__rank"], "left_semi").drop("__rank")


def enrich(stored: DataFrame, fresh: DataFrame, keep_old: bool = True) -> DataFrame:
    """Refresh extension columns by (code, date). Without ``keep_old`` unmatched rows lose theirs."""
    ext = [c for c in EXTENSION_COLUMNS if c in fresh.columns]
    new = fresh.select("code", "date", *[F.col(c).alias(f"__{c}") for c in ext])
    out = stored.join(new, ["code", "date"], "left")
    for c in ext:
        old = F.col(c) if keep_old and c in stored.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), old))
    return out.drop(*[f"__{c}" for c in ext])


def upsert(
    stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("code", "date"), keep: str = "new", seq: str | None = None,
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Union with one row per key: the new one, or with ``keep="old"`` the stored one.

    If one side may repeat a key, ``seq`` names its arrival order: keeping new keeps
    the last arrival, keeping old the first. ``deal`` places the rows of both sides before one is chosen.
    """
    rank = {"new": (0, 1), "old": (1, 0)}[keep]
    both = stored.withColumn("__p", F.lit(rank[0])).unionByName(
        new.withColumn("__p", F.lit(rank[1])), allowMissingColumns=True
    )
    order = [] if seq is None else [F.col(seq) if keep == "new" else -F.col(seq)]
    return _pick(both if deal is None else deal(both), keys, ["__p", *order], drop=["__p"])


def merge_constituents(stored: DataFrame, fetched: DataFrame, force: bool = False) -> DataFrame:
    """Add sectors not stored yet (all, and nothing stored, when forced); distinct and sorted."""
    if force:
        both = fetched
    else:
        new = fetched.join(stored.select("sector_name").distinct(), "sector_name", "left_anti")
        both = stored.unionByName(new)
    return (
        both.dropDuplicates(["sector_name", "code"]).orderBy("sector_type", "sector_name", "code")
    )


def retry_set(tasks: DataFrame, failed: DataFrame) -> DataFrame:
    """The failed codes' tasks, from the start of history."""
    again = tasks.join(failed.select("code").distinct(), "code", "left_semi")
    return again.withColumn("max_date", F.lit(None).cast("date"))


# The sources a run report counts; others count as merged.
COUNTED_SOURCES = ("tdx", "akshare", "baostock", "merged")


def last_records(log: DataFrame) -> DataFrame:
    """The last record per code and status."""
    return _pick(log, ["code", "status"], ["seq"])


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count_distinct("code").alias("codes"))


def source_counts(log: DataFrame) -> DataFrame:
    """Every successful call counts, repeats included."""
    src = F.when(F.col("source").isin(*COUNTED_SOURCES), F.col("source")).otherwise("merged")
    return log.filter("status = 'success'").groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("calls"))


def _missing(stored_dates: DataFrame, universe: DataFrame, as_of: Column, force_full: bool) -> DataFrame:
    """(code, market, start_date, end_date, fresh, ...): what each code of the universe lacks up to ``as_of``."""
    market = F.col("market") if "market" in universe.columns else F.lit(None).cast("int").alias("market")
    tasks = universe.select("code", market).dropDuplicates(["code"]).join(q.max_dates(stored_dates), "code", "left")
    if force_full:
        tasks = tasks.withColumn("max_date", F.lit(None).cast("date"))
    return q.missing_range(tasks, as_of).withColumn("fresh", q.is_up_to_date("max_date", as_of))


def _delivered(primary: DataFrame, secondary: DataFrame, tertiary: DataFrame, span: DataFrame) -> DataFrame:
    """The missing rows of every code from the first source that has it, tagged ``source``; stored once.

    The first two sources are read several times, so what is wanted of them is stored too:
    each source is worked out once.
    """
    due = span.filter("NOT fresh").select("code", "start_date", "end_date")

    def wanted(df):
        return df.join(due, "code").filter("date BETWEEN start_date AND end_date").drop("start_date", "end_date")

    a, b, c = cut_lineage(wanted(primary)), cut_lineage(wanted(secondary)), wanted(tertiary)
    dual = merge_dual(a, b)
    has_b = b.select("code").distinct().withColumn("__b", F.lit(True))
    dual = dual.join(has_b, "code", "left").withColumn(
        "source",
        F.when(F.col("origin") == "secondary", "akshare").when(F.col("__b"), "merged").otherwise("tdx"),
    ).drop("origin", "__b")
    rest = c.join(dual.select("code").distinct(), "code", "left_anti").withColumn("source", F.lit("baostock"))
    return cut_lineage(dual.unionByName(rest, allowMissingColumns=True))


def _whole(after: DataFrame) -> DataFrame:
    """(code, whole, broken) of the merged rows.

    Stored rows lie in date order, so that order cannot be wrong; repeated dates can be.
    """
    checked = q.validate_merged(after.withColumn("seq", F.unix_date("date").cast("long")))
    return checked.select("code", F.col("ok").alias("whole"), F.col("reason").alias("broken"))


def _load_log(
    span: DataFrame, checked: DataFrame, whole: DataFrame, source: DataFrame, rows: DataFrame, run: int
) -> DataFrame:
    log = (
        span.select("code", "market", "fresh")
        .join(checked.select("code", "ok", "reason"), "code", "left")
        .join(whole, "code", "left").join(source, "code", "left").join(rows, "code", "left")
    )
    fine = F.coalesce("ok", F.lit(False)) & F.coalesce("whole", F.lit(False))
    none = F.lit(None).cast("string")

    def record(status, why):
        return F.struct(F.lit(status).alias("status"), why.alias("reason"))

    records = (
        F.when(F.col("fresh"), F.array(record("skipped", F.lit("already_up_to_date"))))
        .when(fine, F.array(record("success", none)))
        .when(F.col("reason").isNull(), F.array(record("failed", F.lit("complete_fail"))))
        .when(F.col("ok"), F.array(record("failed", F.concat(F.lit("merge_validate:"), "broken"))))
        .otherwise(F.array(
            record("validation", F.col("reason")), record("failed", F.concat(F.lit("validate:"), "reason"))
        ))
    )
    log = log.withColumn("__ok", fine & ~F.col("fresh")).withColumn("__r", F.explode(records))
    return log.select(
        "code", "market", F.col("__r.status").alias("status"), F.when(F.col("__ok"), F.col("source")).alias("source"),
        F.when(F.col("__ok"), F.col("stored_rows")).alias("rows"), F.col("__r.reason").alias("reason"),
        F.lit(run).cast("long").alias("seq"),
    )


def _checked(new: DataFrame) -> DataFrame:
    return q.validate(new.withColumnRenamed("volume", "vol") if "vol" not in new.columns else new)


def ingest(
    primary: DataFrame, secondary: DataFrame, tertiary: DataFrame, stored: DataFrame,
    universe: DataFrame, as_of: Column, force_full: bool = False, run: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The daily load as one plan: (table to store, run log).

    Per code: what is missing up to ``as_of``, first source that has it, validation, upsert,
    check of the merged rows. A code that fails keeps its stored rows and gets a log row;
    one that fails validation gets two, ``validation`` and ``failed``. The log has (code,
    market, status, source, rows, reason, seq), seq the number of this run, and is what run
    reports and failed lists read. ``universe`` may name each code's market.
    """
    span = _missing(stored, universe, as_of, force_full)
    # Read several times below: validation, merged check, table, sources and log.
    new = _delivered(primary, secondary, tertiary, span)
    checked = _checked(new)
    good = new.join(checked.filter("ok"), "code", "left_semi")
    if force_full:
        after = good
    else:
        mine = stored.join(checked.filter("ok").select("code"), "code", "left_semi")
        after = upsert(mine, good)
    after = cut_lineage(after)
    whole = _whole(after)
    done = after.join(whole.filter("whole"), "code", "left_semi")
    merged = stored.join(whole.filter("whole"), "code", "left_anti").unionByName(done, allowMissingColumns=True)
    source = good.groupBy("code").agg(F.first("source").alias("source"))
    rows = done.groupBy("code").agg(F.count(F.lit(1)).alias("stored_rows"))
    return merged.drop("source"), _load_log(span, checked, whole, source, rows, run)


def ingest_in_place(
    primary: DataFrame, secondary: DataFrame, tertiary: DataFrame, path: str, universe: DataFrame, as_of: Column,
    force_full: bool = False, run: int = 0, **how,
) -> tuple[int, DataFrame]:
    """:func:`ingest` into a table of snapshots at ``path``: (version committed, run log).

    Of the stored table only codes and dates are scanned, and the files that new rows fall into
    are read and written; all other files stay as they are. Codes that fail keep their
    stored rows. Two loads at once: the later one raises ``Conflict`` and changes nothing.
    """
    from tickloom.sources import snapshots

    spark = primary.sparkSession
    base = max(snapshots.versions(spark, path), default=None)
    if base is None:
        stored = spark.createDataFrame([], primary.select("code", "date").schema)
    else:
        stored = snapshots.read(spark, path, base).select("code", "date")
    span = cut_lineage(_missing(stored, universe, as_of, force_full))
    new = _delivered(primary, secondary, tertiary, span)
    checked = cut_lineage(_checked(new))
    good = new.join(checked.filter("ok"), "code", "left_semi")
    # Stored bars are unique on code and date, so only a load that replaces codes can leave repeats.
    whole = _whole(good) if force_full else checked.filter("ok").select("code", F.lit(True).alias("whole"), F.lit(None).cast("string").alias("broken"))
    whole = cut_lineage(whole)
    load = good.join(whole.filter("whole"), "code", "left_semi")
    source = good.groupBy("code").agg(F.first("source").alias("source"))
    if force_full:
        rows = load.groupBy("code").agg(F.count(F.lit(1)).alias("stored_rows"))
    else:
        kept = stored.join(load.select("code").distinct(), "code", "left_semi")
        rows = kept.unionByName(load.select("code", "date")).distinct().groupBy("code").agg(F.count(F.lit(1)).alias("stored_rows"))
    log = cut_lineage(_load_log(span, checked, whole, source, rows, run))
    version = snapshots.change(load.drop("source"), path, whole_codes=force_full, base=base, **how)
    return version, log


def ingest_sectors(
    stored: DataFrame, raw: DataFrame, listed: DataFrame, today: Column, force_full: bool = False,
    start: str = "2010-01-01",
) -> tuple[DataFrame, DataFrame]:
    """Sector bars: skip current sectors, take the rest from the day after their last bar, keep old rows."""
    last = stored.groupBy("sector_name").agg(F.max("date").alias("max_date"))
    tasks = listed.select(F.col("name").alias("sector_name")).distinct().join(last, "sector_name", "left")
    full = F.lit(start).cast("date")
    begin = F.lit(force_full) | F.col("max_date").isNull()
    tasks = tasks.withColumns(
        {
            "skip": ~F.lit(force_full) & F.coalesce(F.col("max_date") >= today, F.lit(False)),
            "start_date": F.when(begin, full).otherwise(F.date_add("max_date", 1)),
        }
    )
    due = tasks.filter("NOT skip").select("sector_name", "start_date")
    got = raw.join(due, "sector_name").filter((F.col("date") >= F.col("start_date")) & (F.col("date") <= today))
    got = got.drop("start_date")
    counts = got.groupBy("sector_name").agg(F.count(F.lit(1)).alias("rows"))
    merged = upsert(stored, got, keys=("sector_name", "date"), keep="old")
    status = (
        F.when(F.col("skip"), "skipped").when(F.col("rows").isNull(), "failed").otherwise("success")
    )
    why = F.when(F.col("skip"), "already_up_to_date").when(F.col("rows").isNull(), "empty_data")
    log = tasks.join(counts, "sector_name", "left").select(
        "sector_name", status.alias("status"), "rows", why.alias("reason")
    )
    return merged, log
