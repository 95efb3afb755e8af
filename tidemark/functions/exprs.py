"""Scalar expressions shared by all operators: safe arithmetic, sessions, book maths, text and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TZ = "America/New_York"
RTH_OPEN, RTH_CLOSE, ROLL_HOUR = 570, 960, 18

# Word lists of the lexicon score, and the characters taken off the ends of words.
POSITIVE = ("beat", "beats", "surge", "surges", "record", "growth", "gain", "gains", "strong", "rally", "upgrade", "boom", "optimism", "profit", "rebound")
NEGATIVE = ("miss", "misses", "recession", "cut", "cuts", "fall", "falls", "weak", "selloff", "downgrade", "fear", "fears", "loss", "slump", "crash", "default")
STRIPPED = ".,!?:;\"'()[]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sdiv(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def corr(x: Column | str, y: Column | str) -> Column:
    """Correlation of the pairs without nulls, null where either side does not vary (Spark's own is a division by zero there)."""
    x, y = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    return sdiv(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope of y on x over the pairs without nulls, null where x does not vary."""
    y, x = F.when(col(x).isNotNull(), col(y)), F.when(col(y).isNotNull(), col(x))
    return sdiv(F.covar_pop(y, x), F.var_pop(x))


def finite(x: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clean(x: Column | str) -> Column:
    """Null where not finite."""
    return F.when(finite(x), col(x))


def pos_ln(x: Column | str) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def us(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def local(ts: Column | str, tz: str = TZ) -> Column:
    return F.from_utc_timestamp(col(ts).cast("timestamp"), tz)


def minute_of_day(ts: Column | str, tz: str = TZ) -> Column:
    t = local(ts, tz)
    return F.hour(t) * 60 + F.minute(t)


def session_tag(ts: Column | str) -> Column:
    """RTH on weekdays from 09:30 (inclusive) to 16:00 (exclusive) exchange time, else ETH."""
    m = minute_of_day(ts)
    rth = (F.weekday(local(ts)) < 5) & (m >= RTH_OPEN) & (m < RTH_CLOSE)
    return F.when(rth, F.lit("RTH")).otherwise(F.lit("ETH"))


def trade_date(ts: Column | str) -> Column:
    """Exchange date, rolled to the next calendar day from 18:00 on."""
    t = local(ts)
    return F.date_add(F.to_date(t), F.when(F.hour(t) >= ROLL_HOUR, 1).otherwise(0))


def time_features(ts: Column | str) -> dict[str, Column]:
    m, d = minute_of_day(ts), F.weekday(local(ts))
    turn, week = m * (2 * 3.141592653589793 / 1440), d * (2 * 3.141592653589793 / 7)
    return {"mod_sin": F.sin(turn), "mod_cos": F.cos(turn), "dow_sin": F.sin(week), "dow_cos": F.cos(week), "mins_since_open": m - RTH_OPEN, "mins_to_close": RTH_CLOSE - m}


def sanitise(name: Column | str) -> Column:
    """Lower case, runs of other characters than letters and digits one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(name))), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by the unit separator; nulls are empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def stable_key(*parts: Column | str) -> Column:
    return F.concat_ws("\u001f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def mid(bid: Column | str, ask: Column | str) -> Column:
    return (col(bid) + col(ask)) / 2


def micro_price(bid: Column | str, bid_size: Column | str, ask: Column | str, ask_size: Column | str) -> Column:
    total = col(bid_size) + col(ask_size)
    return F.coalesce(sdiv(col(bid) * col(ask_size) + col(ask) * col(bid_size), total), mid(bid, ask))


def queue_imbalance(bid_size: Column | str, ask_size: Column | str) -> Column:
    return sdiv(col(bid_size) - col(ask_size), col(bid_size) + col(ask_size))


def order_flow(bid: Column, bid_size: Column, ask: Column, ask_size: Column, p_bid: Column, p_bid_size: Column, p_ask: Column, p_ask_size: Column) -> Column:
    """Order-flow imbalance of one book transition: size that joined or left the best bid, less the same at the best ask."""
    buy = F.when(bid >= p_bid, bid_size).otherwise(0) - F.when(bid <= p_bid, p_bid_size).otherwise(0)
    sell = F.when(ask <= p_ask, ask_size).otherwise(0) - F.when(ask >= p_ask, p_ask_size).otherwise(0)
    return buy - sell


def lexicon_counts(text: Column | str, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> tuple[Column, Column]:
    """Positive and negative words of a text, split at white space, the characters ``STRIPPED`` at their ends off."""
    words = F.transform(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(STRIPPED)))
    return F.size(F.filter(words, lambda w: w.isin(*positive))), F.size(F.filter(words, lambda w: w.isin(*negative)))


def lexicon_scores(pos: Column, neg: Column) -> dict[str, Column]:
    """Three-way distribution with a neutral mass of one, and positive minus negative."""
    total = pos + neg + F.lit(1.0)
    return {"positive_score": pos / total, "negative_score": neg / total, "neutral_score": 1.0 / total, "sentiment_score": (pos - neg) / total}


def tone_score(tone: Column, scale: float = 10.0) -> Column:
    """A tone scaled and clamped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tone / scale))


def theme_match(themes: Column, prefixes: tuple[str, ...]) -> Column:
    """Does any theme of a ';' list start with one of the prefixes?"""
    return F.exists(F.split(themes, ";"), lambda t: F.greatest(*[t.startswith(p).cast("int") for p in prefixes], F.lit(0)) == 1)


def page_title(html: Column | str, closed: bool = False) -> Column:
    """Text of the first title element, character references resolved (a pandas UDF sees the titles only).

    ``closed``: only references that end in a semicolon, so a title cut off within one (``&amp``) keeps what it has of it; else all that HTML allows.
    """
    def resolved(titles):
        import re
        from html import entities, unescape

        if not closed:
            return titles.map(unescape, na_action="ignore")
        one = lambda m: unescape(m[0]) if m[1][0] == "#" or m[1] in entities.html5 else m[0]
        return titles.map(lambda t: re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][0-9A-Za-z]*;)", one, t), na_action="ignore")

    return F.pandas_udf(resolved, "string", F.PandasUDFType.SCALAR)(F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))
