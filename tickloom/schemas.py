"""Fixed schemas of the tables the library reads and writes."""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


STR, DBL, LNG, INT, DAY, TS = (
    StringType(),
    DoubleType(),
    LongType(),
    IntegerType(),
    DateType(),
    TimestampType(),
)

EXTENSION_COLUMNS = ("amplitude", "pct_change", "change", "turnover")

# Stored bars keep the on-disk name `vol`; readers canonicalise it to `volume`.
BARS = _schema(
    code=STR, market=INT, date=DAY, open=DBL, high=DBL, low=DBL, close=DBL,
    vol=LNG, amount=LNG, amplitude=DBL, pct_change=DBL, change=DBL, turnover=DBL,
    source=STR, adjust=STR,
)
SECTOR_LIST = _schema(name=STR, code=STR, sector_type=STR)
SECTOR_DAILY = _schema(
    sector_name=STR, sector_type=STR, date=DAY, open=DBL, high=DBL, low=DBL,
    close=DBL, volume=DBL, amount=DBL, pct_change=DBL, turnover=DBL,
)
SECTOR_MAP = _schema(sector_name=STR, sector_type=STR, code=STR)
FUNDAMENTALS = _schema(
    code=STR, as_of=TS, version=INT, pe_ttm=DBL, pb_lf=DBL, roe_ttm=DBL,
    net_profit_ttm=DBL, revenue_growth=DBL, net_profit_growth=DBL, circ_mv=DBL,
)
SIGNALS = _schema(
    date=DAY, strategy=STR, code=STR, side=STR, score=DBL, weight=DBL, reason=STR
)
TRADES = _schema(trade_id=LNG, ts=TS, code=STR, side=STR, qty=LNG, price=DBL)
QUOTES = _schema(
    code=STR, ts=TS, price=DBL, open=DBL, high=DBL, low=DBL, last_close=DBL,
    vol=LNG, amount=DBL, bid1=DBL, ask1=DBL,
)
VOTES = _schema(code=STR, scan_ts=TS, strategy=STR, side=STR, score=DBL, reason=STR)
LIVE_SIGNALS = StructType(
    [
        StructField("code", STR),
        StructField("signal", STR),
        StructField("score", DBL),
        StructField("price", DBL),
        StructField("strategies_triggered", ArrayType(STR)),
        StructField("merge_rule", STR),
        StructField("ts", TS),
        StructField("reason", STR),
    ]
)
ALERTS = _schema(key=STR, ts=TS, level=STR, subject=STR, body=STR)
RUN_LOG = _schema(code=STR, market=INT, status=STR, source=STR, rows=LNG, reason=STR, seq=LNG)
FAILED_LIST = _schema(code=STR, market=INT, reason=STR)
