"""From bytes to columns, by layout: expressions that Spark compiles, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.layouts import DAY_NS, ITCH, ITCH_HEADER, PITCH, Field, size


def unsigned(payload: Column, offset: int, width: int, big: bool = True) -> Column:
    """An unsigned number as a long; 8-byte numbers from 2^63 on are an error under ANSI rules."""
    if big:
        return F.conv(F.hex(F.substring(payload, offset + 1, width)), 16, 10).cast("long")
    digits = F.concat(*[F.hex(F.substring(payload, offset + k + 1, 1)) for k in reversed(range(width))])
    return F.conv(digits, 16, 10).cast("long")


def value(payload: Column, field: Field, big: bool = True) -> Column:
    if field.kind in ("u", "price4", "price8"):
        return unsigned(payload, field.offset, field.width, big)
    text = F.decode(F.substring(payload, field.offset + 1, field.width), "ISO-8859-1")
    return F.substring_index(text, " ", 1) if field.kind in ("text", "word") else text


def valid(payload: Column, fields: tuple[Field, ...], shortest: int) -> Column:
    """Whether a payload is long enough and its codes are known; null payloads aren't valid."""
    tests = F.octet_length(payload) >= max(shortest, size(fields))
    for f in fields:
        if f.codes:
            tests = tests & value(payload, f).isin(*(f.codes.split() if f.kind == "word" else f.codes))
    return F.coalesce(tests, F.lit(False))


def itch_type(payload: Column) -> Column:
    return F.decode(F.substring(payload, 1, 1), "ISO-8859-1")


def view(raw: DataFrame, kind: str, mode: str = "FAILFAST", payload: str = "payload") -> DataFrame:
    """Messages of one type with header and fields as columns; other columns of raw stay, the payload goes.

    FAILFAST raises on an invalid message, PERMISSIVE leaves it out (invalid() has them), UNCHECKED decodes
    whatever is there, for feeds that were checked before.
    """
    p, fields = F.col(payload), ITCH[kind]
    rows = raw.where(itch_type(p) == kind)
    good = valid(p, fields, 11) & (unsigned(p, 5, 6) < DAY_NS)
    if mode.upper() == "PERMISSIVE":
        rows = rows.where(good)
    elif mode.upper() != "UNCHECKED":
        rows = rows.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"invalid message {kind}: "), F.hex(p))).cast("boolean")))
    columns = [value(p, f).alias(f.name) for f in (*ITCH_HEADER, *fields)]
    return rows.select(*[c for c in raw.columns if c != payload], F.lit(kind).alias("type"), *columns)


def flags(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """raw with type, known (a type that has a layout) and ok (long enough, known codes, time within a day)."""
    p = F.col(payload)
    kind = itch_type(p)
    ok = F.lit(False)
    for name, fields in ITCH.items():
        ok = F.when(kind == name, valid(p, fields, 11) & (unsigned(p, 5, 6) < DAY_NS)).otherwise(ok)
    return raw.withColumns({"type": kind, "known": kind.isin(*ITCH), "ok": F.coalesce(ok, F.lit(False))})


def invalid(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Messages that no view takes, with type and reason: unknown type, too short, time of another day, or unknown code. Null payloads are too short."""
    p = F.col(payload)
    kind = itch_type(p)
    least = F.element_at(F.create_map(*[F.lit(x) for k, fields in ITCH.items() for x in (k, max(11, size(fields)))]), kind)
    short = F.coalesce(F.octet_length(p) < F.coalesce(least, F.lit(1)), F.lit(True))
    reason = F.when(short, "too short").when(~kind.isin(*ITCH), "unknown type").when(unsigned(p, 5, 6) >= DAY_NS, "time of another day")
    found = flags(raw, payload)
    return found.where(~F.col("ok")).withColumn("reason", reason.otherwise("unknown code")).drop("known", "ok")


def pitch_view(raw: DataFrame, kind: int, payload: str = "payload") -> DataFrame:
    """Messages of one type of the little-endian protocol; prices stay raw numbers."""
    p, fields = F.col(payload), PITCH[kind]
    rows = raw.where((unsigned(p, 1, 1) == kind) & (F.octet_length(p) >= size(fields)))
    return rows.select(*[c for c in raw.columns if c != payload], *[value(p, f, big=False).alias(f.name) for f in fields])


def common(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """All book messages in one sparse table: header, order_id, new_order_id, side, shares, stock, px; null where a type lacks it."""
    p = F.col(payload)
    kind = itch_type(p)
    out = {}
    for name in ("order_id", "new_order_id", "side", "shares", "stock", "px"):
        column = None
        for k in "AFECXDU":
            for f in ITCH[k]:
                if f.name == name:
                    column = F.when(kind == k, value(p, f)) if column is None else column.when(kind == k, value(p, f))
        out[name] = column
    header = [value(p, f).alias(f.name) for f in ITCH_HEADER]
    return raw.select(*[c for c in raw.columns if c != payload], kind.alias("type"), *header, *[c.alias(n) for n, c in out.items()])
