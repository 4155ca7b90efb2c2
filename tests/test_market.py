"""The market-data operators: fixed vectors, agreement of both order paths, and every query against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickframe.functions.decode import common, flags, invalid, pitch_view, view
from tickframe.functions.numbers import close_enough, first_differences, next_power_of_two, to_double, to_long
from tickframe.functions.prices import elapsed_text, level_to_price, penny_price, price_levels, price_text, time_text
from tickframe.layouts import ITCH, PITCH
from tickframe.operators import book, fold, histogram, inside, packets, rates
from tickframe.operators.delay import COMPLEX, backward_fft, delayed, delays, forward_fft, random_series, square
from tickframe.plans import oracle, queries
from tickframe.plans.samples import MESSAGES
from tickframe.sources import encode
from tickframe.sources.itch import blocks, read_itch
from tickframe.streaming.live import feed_outputs, live_quotes, packet_messages, publish, run_available

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def values(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x).cast("long")


def test_price_levels(spark):
    cases = [(10000, 10000, 0), (100000, 100100, 1), (100100, 110100, 100), (9995, 10000, 5), (9995, 9999, 4), (9995, 110100, 1006)]
    assert values(spark, *[price_levels(lit(a), lit(b)) for a, b, _ in cases]) == tuple(c for *_, c in cases)
    assert values(spark, *[level_to_price(lit(x)) for x in (5000, 10000, 10900)]) == (5000, 10000, 100000)
    assert values(spark, penny_price(lit(1234567)), penny_price(lit(9999))) == (1234500, 9999)
    for bad in (price_levels(lit(2), lit(1)), level_to_price(lit(-1))):
        with pytest.raises(Exception, match="invalid price"):
            values(spark, bad)


def test_texts(spark):
    ns = (7 * 3600 + 8 * 60 + 9) * 10**9 + 20
    got = values(spark, price_text(lit(12340123)), time_text(lit(ns)), time_text(lit(16 * 3600 * 10**9)), elapsed_text(lit(3723000001)))
    assert got == ("1234.0123", "070809.000000020", "160000.000000000", "01:02:03.000001")


def messages():
    head = {"stock_locate": 0, "tracking_number": 1, "ts_ns": 41_551_123_456_789}
    add = encode.itch("A", **head, order_id=42, side="B", shares=100, stock="HSART", px=1230500)
    return [
        encode.itch("S", **head, event_code="O"),
        add,
        encode.itch("F", **head, order_id=43, side="S", shares=100, stock="HSART", px=1230600, mpid="LOOF"),
        encode.itch("U", **head, order_id=42, new_order_id=4242, shares=100, px=2340600),
        b"Z" + bytes(11),
    ]


def test_decoding(spark):
    raw = spark.createDataFrame([(bytearray(m),) for m in messages()], "payload binary")
    row = view(raw, "A").first()
    assert (row.order_id, row.side, row.shares, row.stock, row.px, row.ts_ns) == (42, "B", 100, "HSART", 1230500, 41_551_123_456_789)
    assert view(raw, "F").first().mpid == "LOOF"
    assert [(r.known, r.ok) for r in flags(raw).collect()] == [(True, True)] * 4 + [(False, False)]
    assert [r.new_order_id for r in common(raw).where("type = 'U'").collect()] == [4242]
    bad = spark.createDataFrame([(bytearray(messages()[0][:-1] + b"?"),)], "payload binary")
    assert view(bad, "S", "PERMISSIVE").count() == 0
    with pytest.raises(Exception, match="invalid message"):
        view(bad, "S").collect()


def test_samples_are_of_struct_formats(spark):
    """The literal messages against bytes packed by other means, for types of every field width."""
    import struct

    head = struct.pack(">HH", 0, 1) + (41_551_123_456_789).to_bytes(6, "big")
    stock = b"HSART   "
    made = {
        "A": struct.pack(">QcI8sI", 42, b"B", 100, stock, 1230500), "C": struct.pack(">QIQcI", 42, 300, 317, b"Y", 1230500),
        "X": struct.pack(">QI", 42, 300), "V": struct.pack(">QQQ", 500001000000, 400001020000, 300001020300),
        "I": struct.pack(">QQc8sIIIcc", 42000000, 424200, b"B", stock, 2340600, 1230500, 890100, b"O", b"A"),
        "H": struct.pack(">8scB4s", stock, b"T", 0, b"MWC1"), "K": struct.pack(">8sIcI", stock, 49405, b"A", 1230500),
    }
    assert {k: bytes.fromhex(MESSAGES[k]) for k in made} == {k: k.encode() + head + v for k, v in made.items()}
    short = spark.createDataFrame([(k, bytearray.fromhex(x)[:-1]) for k, x in MESSAGES.items()], "k string, payload binary")
    assert {r.k: r.reason for r in invalid(short).collect()} == dict.fromkeys(MESSAGES, "too short")
    bad = {"Y": -1, "L": -1, "W": -1, "H": 19, "Q": -1, "I": -1, "C": 31, "S": -1, "R": 27}
    spoilt = []
    for k, at in bad.items():
        raw = bytearray.fromhex(MESSAGES[k])
        raw[at] = ord("?")
        spoilt.append((k, raw))
    df = spark.createDataFrame(spoilt, "k string, payload binary")
    assert {r.k: r.reason for r in invalid(df).collect()} == dict.fromkeys(bad, "unknown code")
    assert view(df.where("k = 'S'"), "S", "UNCHECKED").first().event_code == "?"


#: Little-endian messages as bytes, and their fields.
PITCH_BYTES = {
    0x20: ("0620 9885 0000", {"seconds": 34200}),
    0x21: ("1A21 18D20600 05409B5B99010000 42 204E 5A5A5A202020 D204 01", {"time_offset": 447000, "order_id": 1758178525189, "side": "B", "shares": 20000, "stock": "ZZZ", "px": 1234, "flags": 1}),
    0x29: ("0E29 18D20600 05409B5B99010000", {"time_offset": 447000, "order_id": 1758178525189}),
    0x97: ("0697 18D20600", {"time_offset": 447000}),
    0x25: ("1225 18D20600 05409B5B99010000 64000000", {"time_offset": 447000, "order_id": 1758178525189, "canceled": 100}),
    0x26: ("1026 18D20600 05409B5B99010000 6400", {"time_offset": 447000, "order_id": 1758178525189, "canceled": 100}),
    0x28: ("1328 18D20600 05409B5B99010000 4B00 E803 03", {"time_offset": 447000, "order_id": 1758178525189, "shares": 75, "px": 1000, "flags": 3}),
    0x27: ("1B27 18D20600 05409B5B99010000 F8240100 08E2010000000000 03", {"time_offset": 447000, "order_id": 1758178525189, "shares": 75000, "px": 123400, "flags": 3}),
    0x23: ("1A23 18D20600 05409B5B99010000 64000000 2A00000000000000", {"time_offset": 447000, "order_id": 1758178525189, "shares": 100, "execution_id": 42}),
    0x24: ("2624 18D20600 05409B5B99010000 64000000 C8000000 2A00000000000000 08E2010000000000", {"time_offset": 447000, "order_id": 1758178525189, "shares": 100, "remaining": 200, "execution_id": 42, "px": 123400}),
    0x22: ("2222 18D20600 05409B5B99010000 53 F8240100 5A5A5A202020 08E2010000000000 01", {"time_offset": 447000, "order_id": 1758178525189, "side": "S", "shares": 75000, "stock": "ZZZ", "px": 123400, "flags": 1}),
    0x2F: ("282F 18D20600 05409B5B99010000 53 F8240100 5A5A5A2020202020 08E2010000000000 01 4D504944", {"time_offset": 447000, "order_id": 1758178525189, "side": "S", "shares": 75000, "stock": "ZZZ", "px": 123400, "flags": 1, "participant": "MPID"}),
    0x95: ("2F95 18D20600 5A5A5A2020202020 43 08E2010000000000 64000000 C8000000 18E2010000000000 28E2010000000000", {"time_offset": 447000, "stock": "ZZZ", "auction_type": "C", "reference": 123400, "buy": 100, "sell": 200, "indicative": 123416, "auction_only": 123432}),
}


def test_pitch_bytes(spark):
    assert PITCH_BYTES.keys() == PITCH.keys()
    for kind, (text, want) in PITCH_BYTES.items():
        raw = bytearray.fromhex(text)
        assert raw[0] == len(raw)
        assert pitch_view(spark.createDataFrame([(raw,)], "payload binary"), kind).first().asDict() == want


def test_pitch(spark):
    sample = {"u": 7, "char": "B", "text": "ABC"}
    for kind, fields in PITCH.items():
        made = encode.pitch(kind, **{f.name: sample[f.kind] for f in fields})
        row = pitch_view(spark.createDataFrame([(bytearray(made),)], "payload binary"), kind).first()
        assert row.asDict() == {f.name: sample[f.kind] for f in fields}


@pytest.mark.parametrize("name", ["day.itch", "day.itch.gz"])
def test_source(spark, tmp_path, name):
    encode.write(str(tmp_path / name), messages())
    rows = read_itch(spark, f"file://{tmp_path}").orderBy("msgcnt").collect()
    assert [bytes(r.payload) for r in rows] == messages()
    assert [r.msgoffset for r in rows][:2] == [2, 16]
    pushed = read_itch(spark, f"file://{tmp_path}").where("type in ('A', 'F')")
    assert pushed.count() == 2


def test_truncated(spark, tmp_path):
    (tmp_path / "x.itch").write_bytes(encode.framed(messages())[:-3])
    assert read_itch(spark, f"file://{tmp_path}", mode="PERMISSIVE").count() == 4
    with pytest.raises(Exception, match="cut off"):
        read_itch(spark, f"file://{tmp_path}").collect()


def test_packets_to_blocks(spark):
    made = [encode.packet("S1", 0, messages()[:3]), encode.packet("S1", 3, []), encode.packet("S1", 3, messages()[3:])]
    rows = blocks(spark.createDataFrame([(bytearray(p),) for p in made], "data binary")).orderBy("seq").collect()
    assert [(r.session, r.seq, bytes(r.payload)) for r in rows] == [("S1", k, m) for k, m in enumerate(messages())]


def test_packetize(spark):
    def run(rows, **options):
        df = spark.createDataFrame([("s", *r) for r in rows], "s string, k long, t long, n long")
        return [(r.first_seq, r.block_count, r.bytes) for r in packets.packet_table(df, "s", "k", "t", "n", **options).orderBy("first_seq").collect()]

    sizes = [(0, 5000, 100), (1, 15000, 90), (2, 25000, 80)]
    assert run(sizes, mtu=1024, delay=5000) == [(0, 1, 122), (1, 1, 112), (2, 1, 102)]
    assert run(sizes, mtu=1024, delay=10**9) == [(0, 3, 296)]
    assert run(sizes, mtu=220, delay=10**9) == [(0, 2, 214), (2, 1, 102)]
    df = spark.createDataFrame([("s", k, *x) for k, x in enumerate([(0, 3), (0, 3), (9, 2), (12, 1), (13, 0)])], "s string, k long, f long, n long")
    assert [r.gap for r in packets.gaps(df, "s", "k", "f", "n").orderBy("k").collect()] == [0, -3, 6, 1, 0]


def rows_of(*messages):
    return [(1, k, *m) for k, m in enumerate(messages)]


SCHEMA = "stock_locate long, msgcnt long, type string, order_id long, new_order_id long, side string, shares long, px long"


def test_order_edges(spark):
    log = rows_of(
        ("A", 1, None, "B", 500, 10), ("A", 1, None, "B", 500, 10), ("E", 9, None, None, 5, None), ("E", 1, None, None, 100, None),
        ("X", 1, None, None, 900, None), ("D", 1, None, None, None, None), ("A", 2, None, "S", 500, 11), ("U", 2, 3, None, 600, 12),
        ("U", 7, 8, None, 1, 1), ("A", 4, None, "S", 5, 13), ("U", 4, 3, None, 5, 14), ("X", 3, None, None, 0, None),
    )
    got = fold.fold(spark.createDataFrame(log, SCHEMA)).orderBy("seq").collect()
    assert [(r.seq, r.side, r.px, r.qty, r.is_replace, r.old_px, r.old_qty) for r in got] == [
        (0, "B", 10, 500, False, 0, 0), (3, "B", 10, -100, False, 0, 0), (4, "B", 10, -400, False, 0, 0), (6, "S", 11, 500, False, 0, 0),
        (7, "S", 12, 600, True, 11, 500), (9, "S", 13, 5, False, 0, 0), (11, "S", 12, -600, False, 0, 0),
    ]


def test_book_and_inside(spark):
    log = rows_of(*[("A", k, None, s, q, p) for k, (s, p, q) in enumerate(
        [("B", 100000, 300), ("B", 110000, 200), ("B", 120000, 100), ("S", 150000, 100), ("S", 160000, 200), ("S", 170000, 300)]
    )])
    state = book.states(fold.fold(spark.createDataFrame(log, SCHEMA)), 2)
    last = state.orderBy(F.desc("seq")).first()
    assert (last.bid_px, last.bid_qty, last.offer_px, last.offer_qty, last.buy_levels, last.sell_levels) == (120000, 100, 150000, 100, 3, 3)
    assert [(x.px, x.qty) for x in last.bids] == [(120000, 100), (110000, 200)]
    assert (last.worst_bid_px, last.worst_offer_px) == (100000, 170000)
    assert sorted(r.seq for r in inside.inside_reported(state).collect()) == [0, 1, 2, 3]


def test_order_types(spark):
    """Adds with a participant and executions at a price are adds and executions."""
    log = rows_of(("F", 1, None, "B", 500, 10), ("C", 1, None, None, 200, 99), ("X", 1, None, None, 100, None), ("C", 1, None, None, 200, 7))
    got = fold.fold(spark.createDataFrame(log, SCHEMA)).orderBy("seq").collect()
    assert [(r.px, r.qty) for r in got] == [(10, 500), (10, -200), (10, -100), (10, -200)]


def test_feed_errors(spark):
    rows = [(k, "s", side, px, qty, False, 0, 0) for k, (side, px, qty) in enumerate([("B", 10, 5), ("B", 11, -5), ("B", 10, -9), ("S", 2_000_000_000, 1), ("S", 7, 0)])]
    rows.append((5, "s", "B", 12, 3, True, 10, 4))
    df = spark.createDataFrame(rows, "seq long, stock string, side string, px long, qty long, is_replace boolean, old_px long, old_qty long")
    got = [(r.feed_error, r.bid_px, r.bid_qty) for r in book.states(df).orderBy("seq").collect()]
    assert got == [
        (None, 10, 5), ("no such level", 10, 5), ("more than the level has", 0, 0), ("price out of range", 0, 0), ("no quantity", 0, 0), ("no such level", 12, 3),
    ]
    with pytest.raises(Exception, match="no such level"):
        book.states(df, mode="FAILFAST").collect()


def random_log(seed, n=400):
    pick, live, out = random.Random(seed), [], []
    for k in range(n):
        kind = pick.choice("AAAEXDU")
        ref = pick.choice(live) if live and pick.random() < 0.9 else 10**6
        if kind == "A":
            live.append(k)
            out.append(("A", k, None, pick.choice("BS"), pick.randint(1, 50), pick.randint(1, 20) * 100))
        elif kind == "U":
            live.append(k)
            out.append(("U", ref, k, None, pick.randint(1, 50), pick.randint(1, 20) * 100))
        else:
            out.append((kind, ref, None, None, pick.randint(0, 60), None))
    return rows_of(*out)


def test_states_equal_intervals(spark):
    """The folded book against level intervals, on random logs."""
    from tickframe.operators.orders import deltas

    accepted = fold.fold(spark.createDataFrame(random_log(7), SCHEMA)).cache()
    levels = [tuple(r) for r in book.level_intervals(deltas(accepted)).select("side", "px", "qty", "seq_from", "seq_to").collect()]
    for r in book.states(accepted).collect():
        alive = [(s, p, q) for s, p, q, a, b in levels if a <= r.seq and (b is None or r.seq < b)]
        bids, offers = [x[1:] for x in alive if x[0] == "B"], [x[1:] for x in alive if x[0] == "S"]
        assert (r.bid_px, r.bid_qty) == (max(bids) if bids else (0, 0))
        assert (r.offer_px, r.offer_qty) == (min(offers) if offers else (2_000_000_000, 0))
        assert (r.buy_levels, r.sell_levels) == (len(bids), len(offers))


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame(random_log(3, 300), SCHEMA).withColumnsRenamed({"stock_locate": "stock", "msgcnt": "seq"})
    for part in range(2):  # two files, two micro-batches
        log.where((F.col("seq") >= 150 * part) & (F.col("seq") < 150 * (part + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        run_available(live_quotes(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    names = ["seq", "side", "px", "qty", "bid_px", "bid_qty", "offer_px", "offer_qty"]
    batch = book.states(fold.fold(log, "stock", "seq")).select(*names)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out")).select(*names)) == key(batch)


def test_live_ids_have_64_bits(spark, tmp_path):
    """A replaced order's new id beyond 2^53 is found again, also when other messages have none."""
    high = (1 << 60) + 1
    log = [(1, 0, "A", 5, None, "B", 10, 100), (1, 1, "U", 5, high, None, 20, 200), (1, 2, "X", high, None, None, 5, None)]
    names = "stock long, seq long, type string, order_id long, new_order_id long, side string, shares long, px long"
    spark.createDataFrame(log, names).coalesce(1).write.parquet(str(tmp_path / "in"))
    run_available(live_quotes(spark.readStream.schema(names).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").select("seq", "qty", "bid_px", "bid_qty").collect()
    assert [tuple(r) for r in got] == [(0, 10, 100, 10), (1, 20, 200, 20), (2, -5, 200, 15)]


def test_feed_handler(spark, tmp_path):
    """Packets in files, over two micro-batches, to several outputs."""
    log = [(k, 1, *m) for k, m in enumerate([("A", 1, "B", 500, 100000), ("A", 2, "B", 100, 110000), ("F", 3, "S", 50, 120000), ("A", 4, "B", 5, 90000)])]
    head = {"stock_locate": 1, "tracking_number": 0, "ts_ns": 5}
    made = [encode.itch(t, **head, order_id=i, side=s, shares=q, stock="X", px=p, **({"mpid": "M"} if t == "F" else {})) for _, _, t, i, s, q, p in log]
    made.append(encode.itch("X", **head, order_id=2, shares=100))
    for k, part in enumerate((made[:2], made[2:])):
        packet = encode.packet("S", 2 * k, part)
        spark.createDataFrame([(bytearray(packet),)], "data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("data binary").parquet(str(tmp_path / "in"))
        publish(live_quotes(packet_messages(stream)), feed_outputs(), str(tmp_path / "out"), str(tmp_path / "state"))
    read = lambda name: [(r.seq, r.bid_px, r.offer_px) for r in spark.read.parquet(str(tmp_path / "out" / name)).orderBy("seq").collect()]
    assert read("updates") == [(0, 100000, 2_000_000_000), (1, 110000, 2_000_000_000), (2, 110000, 120000), (3, 110000, 120000), (4, 100000, 120000)]
    assert [r[0] for r in read("inside")] == [0, 1, 2] and read("errors") == []


def test_fft(spark):
    df = spark.createDataFrame([([{"re": 1.0, "im": 2.0}, {"re": 0.0, "im": -1.0}],), ([],), (None,)], f"z {COMPLEX.simpleString()}")
    got = [r.x for r in df.select(backward_fft(forward_fft("z")).alias("x")).collect()]
    assert [(round(v.re, 9), round(v.im, 9)) for v in got[0]] == [(2, 4), (0, -2)] and got[1:] == [[], None]
    assert values(spark, F.array_max(random_series(50, 1)) <= 1, random_series(5, 1) == random_series(5, 1), random_series(5, 1) == random_series(5, 2)) == (True, True, False)


def test_number_helpers(spark):
    texts = spark.createDataFrame([(x,) for x in ("12", "-3", "1x", " 1", "", None, "1.5", "1e3", "99999999999999999999")], "t string")
    assert [tuple(r) for r in texts.select(to_long(F.col("t")), to_double(F.col("t"))).collect()] == [
        (12, 12.0), (-3, -3.0), (None, None), (None, None), (None, None), (None, None), (None, 1.5), (None, 1000.0), (None, 1e20),
    ]
    assert values(spark, *[next_power_of_two(lit(x)) for x in (0, 1, 2, 3, 64, 65, 2**40 + 1)]) == (1, 1, 2, 4, 64, 128, 2**41)
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(1.0 + 2e-16), F.lit(2.5))
    assert values(spark, close_enough(lit(3), lit(4)), close_enough(lit(3), lit(5))) == (True, False)
    assert [tuple(x) for x in values(spark, first_differences(a, b))[0]] == [(1, 2.0, 2.5), (2, 3.0, None)]


def quantiles(spark, samples, binning, shares):
    df = spark.createDataFrame([(float(x),) for x in samples], "v double")
    row = histogram.histogram(df, [], "v", binning).select(*[histogram.quantile(q, binning) for q in shares]).first()
    return list(row)


def test_quantiles(spark):
    unit = histogram.IntegerRange(20, 30)
    assert quantiles(spark, [20], unit, [0, 0.5, 1]) == [20, 20, 21]
    assert quantiles(spark, range(20, 29), unit, [0, 0.25, 0.5, 0.75, 1]) == [20, 22, 24, 26, 29]
    cuts = histogram.Cuts([10, 20, 30, 40, 50, 100, 150, 200])
    data = [0, 10, 20, 30, 40, 40, 40, 100, 200, 1000]
    assert quantiles(spark, data, cuts, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1]) == [0, 10, 20, 29, 40, 43, 46, 50, 150, 1000]
    for low, cut in ((5, None), (None, [1]), (None, [2, 1])):
        with pytest.raises(ValueError):
            histogram.IntegerRange(5, low) if cut is None else histogram.Cuts(cut)


def test_mean(spark):
    def run(samples):
        df = spark.createDataFrame([(x,) for x in samples], "v long")
        return histogram.histogram(df, [], "v", unit).select(histogram.mean(unit)).first()[0]

    unit = histogram.IntegerRange(20, 30)
    assert [run([25] * 4 + [27] * 4), run([0] * 3), run([40] * 3), run([0, 0, 20, 20, 20, 50])] == [26, 10, 35, 20]


def plain_rate(times, n):
    """One number per tick, straight from the definition."""
    now, ticks = times[0], []
    for t in times:
        now = max(now, t)
        ticks.append(now)
    return [sum(x - n < t <= x for t in ticks) for x in range(ticks[0], ticks[-1])]


def test_rates_over_many_ranges(spark, monkeypatch):
    """Without keys, more ranges than one, and late events."""
    monkeypatch.setattr(rates, "RANGE_ROWS", 7)
    pick = random.Random(5)
    times = [k // 2 + pick.randint(0, 9) for k in range(200)]
    want = {}
    for rate in plain_rate(times, 4):
        want[rate] = want.get(rate, 0) + 1
    df = spark.createDataFrame(list(enumerate(times)), "o long, t long")
    assert dict(map(tuple, rates.rate_steps(df, [], "t", "o", 4, 1).groupBy("rate").agg(F.sum("weight")).collect())) == want


@pytest.mark.parametrize("times", [[10, 11, 12, 1012, 5012], [3, 1, 7, 7, 2, 30, 29, 31]])
def test_rates(spark, times):
    n = 1000 if times[-1] > 1000 else 5
    df = spark.createDataFrame([("k", k, t) for k, t in enumerate(times)], "key string, o long, t long")
    want = {}
    for rate in plain_rate(times, n):
        want[rate] = want.get(rate, 0) + 1
    for keys in (["key"], []):
        got = rates.rate_steps(df, keys, "t", "o", n, 1).groupBy("rate").agg(F.sum("weight")).collect()
        assert dict(map(tuple, got)) == want
    for bad in ((5, 10), (10, 0), (10, 3)):
        with pytest.raises(ValueError):
            rates.window_ticks(*bad)


def test_delay(spark):
    series = spark.range(1).select(square(4096, 512).alias("a"))
    row = delays(series.select("a", delayed(F.col("a").cast("array<float>"), 125).alias("b")), "a", "b").first()
    assert (row.found, row.delay) == (True, 125)
    zero = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert tuple(delays(zero, "a", "b").first()) == (False, 0, 0.0)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_oracle(spark, data, con, name):
    got = queries.QUERIES[name](spark, data)
    want = con.sql(oracle.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr(tuple(plain(x) for x in r)) for r in got.select(*columns).collect())
    assert rows == sorted(repr(tuple(plain(x) for x in r)) for r in want.select(", ".join(columns)).fetchall())


def test_all_types_decode(spark, data):
    """One message of each type, as bytes packed apart from the layouts, says what it should; the query has each type from the tables."""
    from tickframe.plans.samples import FIELDS, MESSAGES

    raw = flags(spark.createDataFrame([(bytearray.fromhex(x),) for x in MESSAGES.values()], "payload binary")).where("ok").select("payload")
    for k, want in FIELDS.items():
        one = view(raw, k)
        said = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in one.columns if c != "type"])
        assert [r[0] for r in one.select(said).collect()] == [want]
    assert queries.decode_roundtrip(spark, data).select("type").distinct().count() == len(ITCH)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_read_kept_bytes(spark, data):
    """The checks refer to the bytes many times; the bytes' own expression isn't in each of these places."""
    assert "unhex" not in _plan(queries.invalid_messages(spark, data)).lower()


@pytest.mark.parametrize("name, types", [("decode_roundtrip", 19), ("pitch_roundtrip", 13)])
def test_decoders_read_their_type_only(spark, data, name, types):
    assert _plan(queries.QUERIES[name](spark, data)).count("PartitionFilters: [isnotnull(folder") == types


def test_feed_statistics(spark, tmp_path):
    from tickframe.operators.statistics import feed_statistics, write_csv

    rows = [("a", k, 1_000 * k, 5) for k in range(10)] + [("b", 10, 9_500, 7)]
    names = spark.createDataFrame([("a",), ("c",)], "Name string")
    df = feed_statistics(spark.createDataFrame(rows, "s string, o long, t long, p long"), "s", "t", "o", "p", names)
    got = {r.Name: r for r in df.collect()}
    assert {k: r.NSamples for k, r in got.items()} == {"a": 10, "b": 1, "c": 0, "__aggregate__": 11}
    assert (got["a"].minArrival, got["a"].maxArrival, got["__aggregate__"].minArrival, got["b"].minArrival) == (1000, 1000, 500, None)
    assert (got["a"].minProcessing, got["__aggregate__"].maxProcessing, got["c"].maxRatePerSec) == (5, 7, None)
    assert got["a"].maxRatePerMSec == 9 and len(df.columns) == 2 + 27 + 12 + 10
    write_csv(df, str(tmp_path / "csv"))
    lines = [x for f in sorted((tmp_path / "csv").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("Name,")]
    assert [x.split(",")[0] for x in lines] == ["a", "b", "c", "__aggregate__"] and len({x.count(",") for x in lines}) == 1


def test_subtypes(spark):
    row = {"stock_locate": 0, "tracking_number": 0, "ts_ns": 0, "stock": "X", "market_category": "G", "financial_status": "N", "round_lot": 100}
    row |= {"roundlots_only": "N", "classification": "O", "authenticity": "P", "short_sale": "N", "ipo": "N", "luld_tier": "1", "etp": "N"}
    made = [encode.itch("R", **row, etp_leverage=0, inverse="N", subtype=x) for x in ("C", "WC", "ZZ")]
    raw = spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(made)], "k int, payload binary")
    assert [r.ok for r in flags(raw).orderBy("k").collect()] == [True, True, False]
    assert [r.subtype for r in view(raw, "R", "PERMISSIVE").orderBy("k").collect()] == ["C", "WC"]
