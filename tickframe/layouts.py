"""Message layouts: for each protocol and type the fields, as name, offset, width, kind.

Kinds: u (unsigned number), price4 and price8 (raw prices), char (one code of a set), text (cut at the first
space), word (text that is one of a set), fixed (kept whole). Values of this module are fixed by the protocols.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    width: int
    kind: str
    codes: str = ""


def _fields(text: str) -> tuple[Field, ...]:
    out = []
    for part in text.split(";"):
        name, offset, width, kind, *codes = part.strip().split(" ", 4)
        out.append(Field(name, int(offset), int(width), kind, codes[0].strip("'") if codes else ""))
    return tuple(out)


#: Header of every message of the first protocol, big-endian: type, locate, tracking, time in ns since midnight.
ITCH_HEADER = _fields("stock_locate 1 2 u; tracking_number 3 2 u; ts_ns 5 6 u")
ITCH_HEADER_SIZE = 11
DAY_NS = 86_400_000_000_000

# The issue subtypes of the stock directory.
SUBTYPES = (
    "A AI B C CB CF CL CM CO CT CU CW D E EG EI EM EN EU F FI FL G I IR IW IX J L LL M MF ML MT N O P PP PU Q R RC RF RT RU S SC SI T TC TU "
    "U V W WC X Y Z"
)
# Offsets, widths and code sets of the 19 types.
ITCH = {
    "S": _fields("event_code 11 1 char 'OSQMEC'"),
    "R": _fields(
        "stock 11 8 text; market_category 19 1 char 'QGSNAPZ '; financial_status 20 1 char 'DEQSGHJKCN '; round_lot 21 4 u;"
        "roundlots_only 25 1 char 'YN'; classification 26 1 char 'ABCFILNOPQRSTUVW'; subtype 27 2 word " + SUBTYPES + ";"
        " authenticity 29 1 char 'PT';"
        "short_sale 30 1 char 'YN '; ipo 31 1 char 'YN '; luld_tier 32 1 char '12 '; etp 33 1 char 'YN '; etp_leverage 34 4 u;"
        "inverse 38 1 char 'YN'"
    ),
    "H": _fields("stock 11 8 text; state 19 1 char 'HPQT'; reserved 20 1 u; reason 21 4 text"),
    "Y": _fields("stock 11 8 text; action 19 1 char '012'"),
    "L": _fields("mpid 11 4 text; stock 15 8 text; primary 23 1 char 'YN'; mode 24 1 char 'NPSRL'; state 25 1 char 'AEWSD'"),
    "V": _fields("level_1 11 8 price8; level_2 19 8 price8; level_3 27 8 price8"),
    "W": _fields("level 11 1 char '123'"),
    "K": _fields("stock 11 8 text; release_seconds 19 4 u; qualifier 23 1 char 'AC'; px 24 4 price4"),
    "A": _fields("order_id 11 8 u; side 19 1 char 'SB'; shares 20 4 u; stock 24 8 text; px 32 4 price4"),
    "F": _fields("order_id 11 8 u; side 19 1 char 'SB'; shares 20 4 u; stock 24 8 text; px 32 4 price4; mpid 36 4 text"),
    "E": _fields("order_id 11 8 u; shares 19 4 u; match 23 8 u"),
    "C": _fields("order_id 11 8 u; shares 19 4 u; match 23 8 u; printable 31 1 char 'YN'; exec_px 32 4 price4"),
    "X": _fields("order_id 11 8 u; shares 19 4 u"),
    "D": _fields("order_id 11 8 u"),
    "U": _fields("order_id 11 8 u; new_order_id 19 8 u; shares 27 4 u; px 31 4 price4"),
    "P": _fields("order_id 11 8 u; side 19 1 char 'SB'; shares 20 4 u; stock 24 8 text; px 32 4 price4; match 36 8 u"),
    "Q": _fields("shares 11 8 u; stock 19 8 text; px 27 4 price4; match 31 8 u; cross_type 39 1 char 'OCHI'"),
    "B": _fields("match 11 8 u"),
    "I": _fields(
        "paired 11 8 u; imbalance 19 8 u; direction 27 1 char 'BSNO'; stock 28 8 text; far 36 4 price4; near 40 4 price4;"
        "reference 44 4 price4; cross_type 48 1 char 'OCHI'; variation 49 1 char 'L123456789ABC '"
    ),
}

# The 13 little-endian layouts of the second protocol; length at 0, type at 1.
_OFFSET = "time_offset 2 4 u"
PITCH = {
    0x20: _fields("seconds 2 4 u"),
    0x21: _fields(f"{_OFFSET}; order_id 6 8 u; side 14 1 char; shares 15 2 u; stock 17 6 text; px 23 2 u; flags 25 1 u"),
    0x22: _fields(f"{_OFFSET}; order_id 6 8 u; side 14 1 char; shares 15 4 u; stock 19 6 text; px 25 8 u; flags 33 1 u"),
    0x2F: _fields(
        f"{_OFFSET}; order_id 6 8 u; side 14 1 char; shares 15 4 u; stock 19 8 text; px 27 8 u; flags 35 1 u; participant 36 4 text"
    ),
    0x23: _fields(f"{_OFFSET}; order_id 6 8 u; shares 14 4 u; execution_id 18 8 u"),
    0x24: _fields(f"{_OFFSET}; order_id 6 8 u; shares 14 4 u; remaining 18 4 u; execution_id 22 8 u; px 30 8 u"),
    0x25: _fields(f"{_OFFSET}; order_id 6 8 u; canceled 14 4 u"),
    0x26: _fields(f"{_OFFSET}; order_id 6 8 u; canceled 14 2 u"),
    0x27: _fields(f"{_OFFSET}; order_id 6 8 u; shares 14 4 u; px 18 8 u; flags 26 1 u"),
    0x28: _fields(f"{_OFFSET}; order_id 6 8 u; shares 14 2 u; px 16 2 u; flags 18 1 u"),
    0x29: _fields(f"{_OFFSET}; order_id 6 8 u"),
    0x97: _fields(_OFFSET),
    0x95: _fields(
        f"{_OFFSET}; stock 6 8 text; auction_type 14 1 char; reference 15 8 u; buy 23 4 u; sell 27 4 u; indicative 31 8 u; auction_only 39 8 u"
    ),
}


def size(fields: tuple[Field, ...]) -> int:
    return max(f.offset + f.width for f in fields)
