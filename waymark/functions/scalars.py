"""Scalar rules as Catalyst expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The symbols a chart shows for each class of journey.
ARROW = "arrow"
SYMBOL_PREFIX = "image://./images/"
SYMBOL_SUFFIX = ".png"
REVERSED = "反"
HIGH_SPEED = "高铁"
MULTIPLE_UNIT = "动车"
CONVENTIONAL = "火车"
PLANE = "飞机"
# The labels of a tooltip.
TOOLTIP_CODE, TOOLTIP_TIME, TOOLTIP_START, TOOLTIP_END, TOOLTIP_NOTE = "班次：", "时间：", "起点：", "终点：", "记录："


def _usable(code: Column) -> Column:
    return code.isNotNull() & (code != "")


def _image(name: Column, start_lng: Column, end_lng: Column) -> Column:
    back = F.when(end_lng < start_lng, F.lit(REVERSED)).otherwise(F.lit(""))
    return F.concat(F.lit(SYMBOL_PREFIX), name, back, F.lit(SYMBOL_SUFFIX))


def train_class(code: Column) -> Column:
    """Class of a train by the first character of its code in either case; null where none fits."""
    first = F.upper(F.substring(code, 1, 1))
    return (
        F.when(first == "G", F.lit(HIGH_SPEED))
        .when(first.isin("D", "C"), F.lit(MULTIPLE_UNIT))
        .when(first.isin("K", "Y", "Z"), F.lit(CONVENTIONAL))
    )


def train_symbol(code: Column, start_lng: Column, end_lng: Column) -> Column:
    """Symbol of a train; westbound ones are reversed, an arrow never is."""
    kind = train_class(code)
    return F.when(_usable(code) & kind.isNotNull(), _image(kind, start_lng, end_lng)).otherwise(F.lit(ARROW))


def flight_symbol(code: Column, start_lng: Column, end_lng: Column) -> Column:
    """Symbol of a flight; westbound ones are reversed."""
    return F.when(_usable(code), _image(F.lit(PLANE), start_lng, end_lng)).otherwise(F.lit(ARROW))


def marker_size(count: Column) -> Column:
    return F.log(count + F.lit(1)) * F.lit(10.0)


def curveness(rank: Column) -> Column:
    """In doubles: decimal literals would round differently."""
    return F.lit(0.3).cast("double") + rank * F.lit(0.05).cast("double")


def period(*keys: Column) -> Column:
    """4 to 8, drawn from a hash of the keys so that a retried task draws the same."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long")
    return (F.pmod(drawn, F.lit(5)) + F.lit(4)).cast("int")


def hover(kind: Column, line: Column, name: Column) -> Column:
    """What is shown over an item: a line has its own text, anything else its name."""
    return F.when(kind == "lines", line).otherwise(name)


def tooltip(code: Column, time: Column, start: Column, end: Column, note: Column) -> Column:
    """Text of an edge; an absent part is empty, and an absent or empty note is left out."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    part = lambda label, c: F.concat(F.lit(label), text(c), F.lit("<br/>"))
    return F.concat(
        part(TOOLTIP_CODE, code),
        part(TOOLTIP_TIME, time),
        part(TOOLTIP_START, start),
        part(TOOLTIP_END, end),
        F.when(text(note) != "", F.concat(F.lit(TOOLTIP_NOTE), text(note))).otherwise(F.lit("")),
    )
