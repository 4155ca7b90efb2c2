"""The registered queries of the market-data operators, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.prices import level_to_price, penny_price, price_levels, price_text, time_text
from tickframe.operators import book, delay, fold, histogram, inside, orders, packets, rates, reduce, select, statistics
from tickframe.plans.oracle import HOUR, MINUTE
from tickframe.sources.adapters import feed
from tickframe.sources.itch import ItchSource
from tickframe.sources.shared import kept

LAG = 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.lifecycle(feed(spark, sf_dir))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.updates(states(spark, sf_dir))


def books(spark: SparkSession, sf_dir: str, levels: int = 0) -> DataFrame:
    return book.states(updates(spark, sf_dir), levels)


_QUOTE = ("bid_px", "bid_qty", "offer_px", "offer_qty")


def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir)


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("messages"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("seq") % 2 == 0, "B").otherwise("S")
    rows = feed(spark, sf_dir).where("type = 'E'")
    return rows.select(
        "ts_ns", F.col("ref").alias("order_id"), side.alias("side"), "shares", "stock", price_text(F.col("px")).alias("price"), F.col("seq").alias("match")
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select("stock").distinct()


def order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates(spark, sf_dir).drop("ts_us", "ts_ns")


def skipped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).where("not accepted").select("seq", "stock", "type", "ref")


def order_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir).where("chain > 0")
    order = F.coalesce("order_id", "ref")
    last = F.max(F.struct("seq", "left")).alias("last")
    first = F.min(F.struct("seq", "stock", "side", "px", F.col("shares").alias("size"), "accepted")).alias("first")
    found = rows.groupBy(order.alias("order_id")).agg(last, first).where("first.accepted")
    return found.select("order_id", "first.stock", "first.side", "first.px", "first.size", F.col("last.left").alias("remaining"))


def replace_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = states(spark, sf_dir).where("accepted and order_id is not null")
    return alive.groupBy("stock", "chain").agg(
        F.min("seq").alias("first_order"), F.max("seq").alias("last_order"), F.count(F.lit(1)).alias("orders")
    )


def level_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.level_quantity(orders.deltas(updates(spark, sf_dir)))


def level_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.level_intervals(orders.deltas(updates(spark, sf_dir)))


def bbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("seq", "stock", *_QUOTE)


def consolidated_bbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book of all securities' orders, the busiest there can be, folded in ranges side by side."""
    one = updates(spark, sf_dir).withColumn("stock", F.lit(0).cast("long"))
    return book.states_in_ranges(one, rows=1_000).select("seq", *_QUOTE)


def worst_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("seq", "stock", "worst_bid_px", "worst_bid_qty", "worst_offer_px", "worst_offer_qty")


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("seq", "stock", "buy_levels", "sell_levels", (F.col("buy_levels") + F.col("sell_levels")).alias("levels"))


def inside_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside.inside_reported(books(spark, sf_dir)).select("seq", "ts_ns", "stock", *_QUOTE)


def inside_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside.inside_reported(books(spark, sf_dir)).select("seq", inside.inside_line().alias("line"))


def inside_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside.inside_changed(books(spark, sf_dir)).select("seq", "stock", *_QUOTE)


def published_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside.published(books(spark, sf_dir)).select("seq", "stock", "side", "px", *_QUOTE)


def top_n_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = books(spark, sf_dir, 4).select("seq", "stock", F.explode(F.create_map(F.lit("B"), "bids", F.lit("S"), "offers")).alias("side", "levels"))
    each = both.select("seq", "stock", "side", F.posexplode("levels").alias("at", "level"))
    return each.select("seq", "stock", "side", (F.col("at") + 1).cast("long").alias("place"), "level.px", "level.qty")


def _order_px() -> Column:
    return F.round(F.col("o_totalprice") * 100).cast("long") * 100


def price_levels_(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _order_px()
    return _table(spark, sf_dir, "orders").select("o_orderkey", price_levels(F.floor(px / 4).cast("long"), px).alias("levels"))


def level_to_price_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", level_to_price(F.col("o_orderkey") % 30_000).alias("price"))


def penny_book_bbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = orders.updates(orders.lifecycle(feed(spark, sf_dir, exact=True)))
    cents = exact.withColumns({"px": penny_price(F.col("px")), "old_px": penny_price(F.col("old_px"))})
    return book.states(cents).select("seq", "stock", *_QUOTE)


def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("seq", "stock", inside.book_depth().alias("depth"))


def event_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("seq", "stock", inside.event_depth().alias("depth"))


_DEPTHS = histogram.IntegerRange(0, 8192)


def _stats(samples: DataFrame, keys: list[str], value: str, binning, shares: dict[str, float], weight: str | None = None, overall: bool = False) -> DataFrame:
    return histogram.summary(histogram.bins(samples, keys, value, binning, weight), keys, binning, shares, overall)


def book_depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(book_depth(spark, sf_dir), [], "depth", _DEPTHS, histogram.DEPTH)


def event_depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(event_depth(spark, sf_dir), [], "depth", _DEPTHS, histogram.DEPTH)


def depth_stats_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(book_depth(spark, sf_dir), ["stock"], "depth", histogram.IntegerRange(0, 5000), histogram.DEPTH, overall=True)


def interarrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.interarrival(feed(spark, sf_dir), ["stock"], "ts_us", "seq")


def rate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.rate_steps(feed(spark, sf_dir), ["stock"], "ts_us", "seq", 24 * HOUR, HOUR)


def _feed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.rate_steps(feed(spark, sf_dir), [], "ts_us", "seq", HOUR, MINUTE)


def rate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_rates(spark, sf_dir).groupBy("rate").agg(F.sum("weight").alias("weight"))


def rate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_feed_rates(spark, sf_dir), [], "rate", histogram.IntegerRange(0, 1000), histogram.DEPTH, "weight")


def arrival_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = interarrival(spark, sf_dir).select(F.floor(F.col("gap") / MINUTE).cast("long").alias("gap"))
    return _stats(minutes, [], "gap", histogram.IntegerRange(0, 100_000), histogram.ARRIVAL)


def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(rate_steps(spark, sf_dir), ["stock"], "rate", histogram.IntegerRange(0, 100), histogram.DEPTH, "weight")


def feed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics row of each security and of everything; the tests hold it against a plain count."""
    rows = feed(spark, sf_dir).withColumn("ns", F.col("ts_us") * 1000)
    return statistics.feed_statistics(rows, "stock", "ns", "seq")


def live_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that a stream over the feed has merged from its slices of a day when the feed ends."""
    from tickframe.sources.shared import shared_path
    from tickframe.streaming import statistics as live

    day = 86_400 * statistics.SECOND
    rows = feed(spark, sf_dir).select("stock", (F.col("ts_us") * 1000).alias("ns"))
    path = shared_path(spark, "sent")
    rows.write.parquet(path)
    spark.read.parquet(path).agg(F.lit(None).cast("long").alias("stock"), (F.max("ns") + 3 * day).alias("ns")).write.mode("append").parquet(path)  # the end of the feed
    stream = spark.readStream.schema("stock long, ns long").parquet(path)
    out = shared_path(spark, "statistics")
    return live.report(live.run_statistics(live.sliced(stream, "stock", "ns", day, buckets=16), out, f"{out}/checkpoint", day))


def depth_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.depth_statistics(book_depth(spark, sf_dir), "stock", "depth", 5000)


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))


def _bins(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode("bins").alias("x")).select(*keys, "x.bin", F.col("x.w").alias("weight"))


def hist_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(histogram.histogram(_quantities(spark, sf_dir), ["l_returnflag"], "q", histogram.IntegerRange(10, 40)), ["l_returnflag"])


def hist_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _table(spark, sf_dir, "lineitem").select(F.floor("l_extendedprice").cast("double").alias("v"))
    return _bins(histogram.histogram(prices, [], "v", histogram.Cuts([100, 1_000, 10_000, 50_000, 100_000])), [])


def hist_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    binning = histogram.IntegerRange(10, 40)
    rows = histogram.histogram(_quantities(spark, sf_dir), ["l_returnflag"], "q", binning)
    return rows.select("l_returnflag", "n", histogram.mean(binning).alias("mean"))


def hist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_quantities(spark, sf_dir), ["l_returnflag"], "q", histogram.IntegerRange(5, 45), histogram.SUMMARY)


def index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted element at p * n / 100, rounded down, of each priority."""
    rows = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    n = rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.array(*[F.lit(p) for p in (0, 25, 50, 75, 90, 99)])).alias("p")
    wanted = n.select("o_orderpriority", "n", at).select("o_orderpriority", "p", F.expr("p * n div 100").alias("k"))
    found = select.order_statistics(rows, ["o_orderpriority"], "o_totalprice", wanted)
    return wanted.join(found, ["o_orderpriority", "k"]).select("o_orderpriority", "p", F.col("o_totalprice").alias("price"))


def generic_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reductions by reducers that are given as objects, by return flag in the order of the lines: sum, least, largest and where, ascents (order matters)."""
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    )
    reducer = reduce.Together(reduce.Sum(), reduce.Least(), reduce.ArgMax(), reduce.Ascents())
    columns = {"total": ("long", 0), "least": ("long", 1), "most": ("long", 2, 0), "most_at": ("long", 2, 1)}
    columns |= {"first": ("long", 3, 0), "last": ("long", 3, 1), "ascents": ("long", 3, 2)}
    return reduce.results(reduce.reduce(rows, ["l_returnflag"], "cents", "at", reducer), columns)


def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select("seq", price_text(F.col("px")).alias("price"), time_text(F.col("ts_ns")).alias("time"))


def validation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select(
        "seq",
        F.col("type").isin("A", "E", "D", "U").alias("known_type"),
        F.coalesce(F.col("side").isin("B", "S"), F.col("type") != "A").alias("ok_side"),
        (F.col("ts_ns") < 86_400_000_000_000).alias("ok_time"),
        F.col("px").between(0, 2_000_000_000).alias("ok_price"),
    )


def stop_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages before the first one from nine o'clock on: the feed ends there, whatever comes later."""
    rows = feed(spark, sf_dir).select("seq", "ts_ns")
    end = rows.where(F.col("ts_ns") >= 32_400_000_000_000).agg(F.coalesce(F.min("seq"), F.lit(1 << 62)).alias("end"))
    return rows.join(F.broadcast(end), F.col("seq") < F.col("end")).select("seq", "ts_ns")  # one row


def sum_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(delay.sum_square(F.col("embedding")), 6).alias("energy"))


def delay_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(delay.delayed(F.col("embedding"), LAG)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("sample"))


def conj_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's first half against its second, neighbouring samples as real and imaginary part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    at = F.sequence(F.lit(0), F.lit(30))
    part = lambda first: F.transform(at, lambda i: F.struct(F.get(x, i + first).alias("re"), F.get(x, i + first + 1).alias("im")))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(delay.conjugate_multiply(part(0), part(32))).alias("i", "z"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")), 6)
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        total(x).alias("total"),
        F.round(F.array_min(x).cast("double"), 6).alias("low"),
        delay.argmax(x).alias("peak_at"),
        total(F.slice(x, 1, 16)).alias("head"),
    )


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"), delay.delayed(F.col("embedding"), LAG).alias("b"))
    return delay.delays(pairs, "a", "b")


def time_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delays(spark, sf_dir).select("vec_id", "found", "delay")


def time_delay_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delays(spark, sf_dir).select("vec_id", F.round("confidence", 3).alias("confidence"))


LONG_LAG, LAGS, BLOCK = 23, 48, 4_096


def long_delay_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by minute, value as real and quantity as imaginary part, against the same series LONG_LAG minutes later: the sum of each lag, over blocks."""
    minute = F.floor(F.col("ts_us") / MINUTE).cast("long")
    rows = feed(spark, sf_dir).where("px is not null").select("stock", minute.alias("tick"), (F.col("px") / 10_000).alias("re"), F.col("shares").alias("im"))
    rows = rows.withColumn("half", F.col("stock") % 2)
    one = rows.select("half", "tick", "re", "im", F.lit(None).cast("double").alias("later_re"), F.lit(None).cast("double").alias("later_im"))
    later = rows.select("half", (F.col("tick") + LONG_LAG).alias("tick"), F.lit(None).cast("double").alias("re"), F.lit(None).cast("double").alias("im"), F.col("re").alias("later_re"), F.col("im").cast("double").alias("later_im"))
    sums = delay.lag_sums(one.unionByName(later), ["half"], "tick", ["re", "im"], ["later_re", "later_im"], LAGS, BLOCK)
    return sums.select("half", "lag", F.round(F.col("total") / 1000).cast("long").alias("total"))


def inside_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside.grid(books(spark, sf_dir), HOUR)


def packet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a session, messages of 20 to 119 bytes; checked against a plain fold in the tests."""
    rows = feed(spark, sf_dir).select("stock", "seq", (F.col("ts_us") * 1000).alias("ts"), (F.col("shares") + 19).alias("size"))
    return packets.packet_table(rows, "stock", "seq", "ts", "size", mtu=220, delay=6 * HOUR * 1000)


def mold_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("stock").orderBy("seq"))
    rows = feed(spark, sf_dir).select(
        "stock",
        F.col("seq").alias("arrival"),
        (place * 2 - 2 + F.col("shares") % 2).cast("long").alias("first_seq"),
        (F.col("shares") % 3).alias("block_count"),
    )
    return packets.gaps(rows, "stock", "arrival", "first_seq", "block_count")


def _field_value(field, place: int, n: Column) -> Column:
    """A value for a field of a message that the row n gives; plans.oracle has the same in SQL."""
    from tickframe.layouts import DAY_NS

    if field.name == "ts_ns":
        return n * 1_000_003 % DAY_NS
    if field.kind in ("u", "price4", "price8"):
        return (n * (place + 3) + place) % min(1 << (8 * field.width), 1 << 31)
    if field.codes:
        codes = field.codes.split() if field.kind == "word" else list(field.codes)
        return F.element_at(F.array(*map(F.lit, codes)), ((n + place) % len(codes) + 1).cast("int"))
    return F.concat(F.lit("T"), (n % 10 ** (field.width - 1)).cast("string")) if field.width > 1 else F.element_at(F.array(F.lit("B"), F.lit("S")), (n % 2 + 1).cast("int"))


def _said(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of the 19 types in turn, encoded, checked and decoded by expressions: order, type, fields as text."""
    from functools import reduce as folded

    from tickframe.functions.decode import flags, view
    from tickframe.layouts import ITCH, ITCH_HEADER
    from tickframe.sources.encode import payload

    n, kinds = F.col("o_orderkey"), list(ITCH)
    made = {kind: payload(kind, **{f.name: _field_value(f, i, n) for i, f in enumerate((*ITCH_HEADER, *ITCH[kind]))}) for kind in kinds}
    raw = _in_turn(_table(spark, sf_dir, "orders"), "o_orderkey", made)
    raw = flags(raw).where("ok").select("o_orderkey", "payload", "folder")
    views = [view(raw.where(F.col("folder") == kind).drop("folder"), kind) for kind in kinds]
    return folded(DataFrame.unionByName, [v.select("o_orderkey", "type", _said(v.columns[2:]).alias("fields")) for v in views])


def _in_turn(rows: DataFrame, key: str, made: dict) -> DataFrame:
    """key, payload and folder: rows as messages of the types in turn, kept in a folder for each type, so that a decoder reads its own type only.

    Every type is encoded by itself, as one expression for all of them would be too large to compile.
    """
    from functools import reduce as folded

    from tickframe.sources.shared import shared_path

    of = lambda k, kind: rows.where(F.col(key) % len(made) == k).select(key, made[kind].alias("payload"), F.lit(str(kind)).alias("folder"))
    sent, path = folded(DataFrame.unionByName, [of(k, kind) for k, kind in enumerate(made)]), shared_path(rows.sparkSession, "messages")
    sent.write.partitionBy("folder").parquet(path)
    return rows.sparkSession.read.schema(sent.schema).parquet(path)


def pitch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of the 13 little-endian types in turn, encoded and decoded: order, type, fields as text."""
    from functools import reduce as folded

    from tickframe.functions.decode import pitch_view
    from tickframe.layouts import PITCH
    from tickframe.sources.encode import pitch_payload

    n, kinds = F.col("o_orderkey"), list(PITCH)
    made = {kind: pitch_payload(kind, **{f.name: _field_value(f, i, n) for i, f in enumerate(PITCH[kind])}) for kind in kinds}
    raw = _in_turn(_table(spark, sf_dir, "orders"), "o_orderkey", made)
    views = [(kind, pitch_view(raw.where(F.col("folder") == str(kind)).drop("folder"), kind)) for kind in kinds]
    return folded(DataFrame.unionByName, [v.select("o_orderkey", F.lit(kind).alias("type"), _said(v.columns[1:]).alias("fields")) for kind, v in views])


def trade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's executions as trade messages, printed as lines into gzipped text, and read back."""
    from tickframe.functions.decode import view
    from tickframe.functions.text import trade_line
    from tickframe.sources.encode import payload
    from tickframe.sources.shared import shared_path

    spark.dataSource.register(ItchSource)
    rows = feed(spark, sf_dir).where("type = 'E' and ref is not null")
    values = {"stock_locate": F.lit(0), "tracking_number": F.lit(0), "ts_ns": F.col("ts_ns"), "order_id": F.col("ref"), "shares": F.col("shares")}
    values |= {"side": F.when(F.col("seq") % 2 == 0, "B").otherwise("S"), "stock": F.col("stock"), "px": F.col("px"), "match": F.col("seq")}
    path = shared_path(spark, "trades")
    lines = view(rows.select(payload("P", **values).alias("payload")), "P").select(trade_line().alias("line"))
    lines.write.format("itch5").options(records="lines", compression="gzip").mode("append").save(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def directory_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth statistics of all securities that directory messages announce, one for each customer, whether or not they have a book."""
    from tickframe.layouts import ITCH, ITCH_HEADER
    from tickframe.sources.encode import payload

    n = F.col("c_custkey")
    values = {f.name: _field_value(f, i, n) for i, f in enumerate((*ITCH_HEADER, *ITCH["R"]))} | {"stock": n}
    names = statistics.directory_names(_table(spark, sf_dir, "customer").select(payload("R", **values).alias("payload")))
    return statistics.depth_statistics(book_depth(spark, sf_dir), "stock", "depth", 5000, names)


def inside_feed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics row, rates, inter-arrival and processing times, of the reported inside updates of each security and of all."""
    quotes = inside.inside_reported(books(spark, sf_dir)).select("stock", "seq", (F.col("ts_us") * 1000).alias("ns"), (F.abs("qty") * 1000 + F.col("seq") % 997).alias("took"))
    return statistics.feed_statistics(quotes, "stock", "ns", "seq", "took")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and payload: the feed as messages of the types A, F, E, C, X, D and U; a message without a reference names an order that isn't there."""
    rows = feed(spark, sf_dir)
    return rows.select("seq", _message(rows).alias("payload"))


def _message(rows: DataFrame) -> Column:
    """The bytes of the feed's messages. A locate has 16 bits, so the tracking number tells which feed of 65,536 securities it is of."""
    from tickframe.sources.encode import payload

    stock = F.when(F.col("stock").between(0, (1 << 32) - 1), F.col("stock")).otherwise(F.raise_error(F.lit("a security beyond the feeds")).cast("long"))
    head = {"stock_locate": stock % 65_536, "tracking_number": F.floor(stock / 65_536), "ts_ns": F.col("ts_ns")}
    ref = F.coalesce("ref", F.lit(1 << 62))
    own = {"side": F.col("side"), "shares": F.col("shares"), "stock": F.col("stock"), "px": F.col("px")}
    odd, third = F.col("seq") % 2 == 1, F.col("seq") % 3
    kinds = {"A": (F.col("type") == "A") & ~odd, "F": F.col("type") == "A", "E": (F.col("type") == "E") & (third == 0)}
    kinds |= {"C": (F.col("type") == "E") & (third == 1), "X": F.col("type") == "E", "D": F.col("type") == "D", "U": F.col("type") == "U"}
    fields = {
        "A": own | {"order_id": F.col("order_id")},
        "F": own | {"order_id": F.col("order_id"), "mpid": F.lit("TICK")},
        "E": {"order_id": ref, "shares": F.col("shares"), "match": F.col("seq")},
        "C": {"order_id": ref, "shares": F.col("shares"), "match": F.col("seq"), "printable": F.lit("Y"), "exec_px": F.col("px")},
        "X": {"order_id": ref, "shares": F.col("shares")},
        "D": {"order_id": ref},
        "U": {"order_id": ref, "new_order_id": F.col("order_id"), "shares": F.col("shares"), "px": F.col("px")},
    }
    return F.coalesce(*[F.when(test, payload(k, **(head | fields[k]))) for k, test in kinds.items()])


def _security(messages: DataFrame) -> DataFrame:
    """Decoded messages with security, the number of the feed and the locate in it."""
    return messages.withColumn("security", F.col("tracking_number") * 65_536 + F.col("stock_locate"))


def _inside_of(messages: DataFrame) -> DataFrame:
    from tickframe.functions.decode import common

    updates_ = fold.fold(_security(common(messages)), "security", "seq")
    return inside.inside_reported(book.states(updates_, mode="FAILFAST")).select("seq", "stock", *_QUOTE)


#: Messages of a file, about, and bytes of a split that one task reads (small enough to split the files of small tables).
FILE_MESSAGES, SPLIT_BYTES = 20_000_000, 1 << 17


def file_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written as large length-framed files, one after another, and read back in splits: frames, decoding, orders, books, reported inside quotes."""
    from tickframe.sources.itch import read_itch
    from tickframe.sources.shared import shared_path

    path, messages = shared_path(spark, "frames"), _encoded(spark, sf_dir)
    days = messages.count() // FILE_MESSAGES + 1
    spark.dataSource.register(ItchSource)
    messages.repartitionByRange(days, "seq").sortWithinPartitions("seq").select("payload").write.format("itch5").mode("append").save(path)
    raw = read_itch(spark, path, "msgcnt long, type string, payload binary", SPLIT_BYTES, numbered=True)
    return _inside_of(raw.where(F.col("type").isin(*"AFECXDU")).select(F.col("msgcnt").alias("seq"), "payload"))


def packet_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as packets over two channels that lose different ones, arbitrated by number: blocks, decoding, orders, books, reported inside quotes."""
    from tickframe.sources.encode import packets as packed
    from tickframe.sources.itch import blocks

    sent = packed(_encoded(spark, sf_dir).withColumn("packet", F.floor(F.col("seq") / 20)), "packet", "TICK")
    channel = lambda n: sent.where(F.col("packet") % 5 != n).select("data")
    received = blocks(channel(1).unionByName(channel(3))).dropDuplicates(["session", "seq"])
    return _inside_of(received.select("seq", "payload"))


#: Sessions that the feed is dealt to, and blocks of a packet.
SESSIONS, PACKET_BLOCKS = 4, 20


def live_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream: packets of several sessions over two channels, out of order and with losses, captured, put in sequence, decoded, folded into live books.

    Each session numbers its own messages; the sender's table of numbers gives the feed's number back.
    """
    from pyspark.sql import Window

    from tickframe.sources.capture import CaptureSource, record
    from tickframe.sources.encode import packets as packed
    from tickframe.sources.shared import shared_path
    from tickframe.streaming import live, sequence

    spark.dataSource.register(ItchSource)
    spark.dataSource.register(CaptureSource)
    rows = feed(spark, sf_dir)
    session = F.concat(F.lit("S"), (F.col("stock") % SESSIONS).cast("string"))
    number = (F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1).cast("long")
    path = shared_path(spark, "numbered")
    sent = rows.select("seq", "ts_us", session.alias("session"), _message(rows).alias("payload")).withColumn("number", number)
    sent.write.parquet(path)
    sent = spark.read.parquet(path)
    packet = sent.withColumn("packet", F.floor(F.col("number") / PACKET_BLOCKS))
    packet = kept(packed(packet, ["session", "packet"], F.col("session"), "number", also={"ts_us": F.max("ts_us")}), "packets")
    captured = shared_path(spark, "captured")
    for channel in (1, 3):
        came = packet.where(F.col("packet") % 5 != channel)
        shaken = F.col("packet") + F.pmod(F.xxhash64("session", "packet", F.lit(channel)), F.lit(6))
        came = came.repartitionByRange("ts_us").sortWithinPartitions(shaken, "session")
        came.select(record(F.col("data"), F.col("ts_us")).alias("data")).write.format("itch5").options(records="packets").mode("append").save(captured)
    in_turn = sequence.sequenced_packets(spark.readStream.format("capture").load(captured), late="3650 days")
    quotes = live.live_quotes(live.messages(in_turn.where("missing = 0")))
    out = shared_path(spark, "live")
    live.run_available(quotes, f"{out}/rows", f"{out}/checkpoint")
    named = spark.read.parquet(f"{out}/rows").withColumn("session", F.concat(F.lit("S"), (F.col("stock") % SESSIONS).cast("string")))
    named = named.withColumnRenamed("seq", "number").join(sent.select("session", "number", "seq"), ["session", "number"])
    return inside.inside_reported(named).select("seq", "stock", *_QUOTE)


def invalid_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's messages, some of them spoilt in one of four ways, that no decoder takes, and why."""
    from tickframe.functions.decode import invalid

    p, way = F.col("payload"), F.col("seq") % 11
    replaced = lambda at, text: F.concat(F.substring(p, 1, at), F.unhex(F.lit(text)), F.substring(p, at + 1 + len(text) // 2, 1 << 20))
    spoilt = F.when(way == 1, replaced(0, "5A")).when(way == 2, F.substring(p, 1, 12)).when(way == 3, replaced(5, "FFFFFFFFFFFF")).otherwise(p)
    spoilt = F.when((way == 4) & F.substring(p, 1, 1).isin(bytearray(b"A"), bytearray(b"F")), replaced(19, "3F")).otherwise(spoilt)
    # the checks refer to the bytes many times, and Spark would put their whole expression into each place
    sent = kept(_encoded(spark, sf_dir), "messages")
    return invalid(kept(sent.withColumn("payload", spoilt), "spoilt")).select("seq", "type", "reason")


def inside_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes between reported inside quotes, of each security and of all in the feed's order."""
    quotes = inside.inside_reported(books(spark, sf_dir)).select("stock", "seq", "ts_us")
    own = rates.interarrival(quotes, ["stock"], "ts_us", "seq").select("stock", "gap")
    whole = statistics.ordered_gaps(quotes.select(F.col("ts_us").alias("t"), F.col("seq").alias("o")))
    gaps = own.unionByName(whole.select(F.lit(None).cast("long").alias("stock"), "gap"))
    minutes = gaps.select("stock", F.floor(F.col("gap") / MINUTE).cast("long").alias("gap"))
    return _stats(minutes, ["stock"], "gap", histogram.IntegerRange(0, 100_000), histogram.ARRIVAL)


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of each vector, and the transform back of it, which is the vector times its length."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", delay.forward_fft("embedding").alias("z"))
    both = rows.select("vec_id", F.posexplode(F.arrays_zip("z", delay.backward_fft("z").alias("x"))).alias("k", "y"))
    part = lambda c: F.round(c, 4) + F.lit(0.0)
    return both.select("vec_id", F.col("k").cast("long").alias("k"), part(F.col("y.z.re")).alias("re"), part(F.col("y.z.im")).alias("im"), part(F.col("y.x.re")).alias("back"))


def number_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from text that is spoilt in places, powers of two, and comparison with tolerance."""
    from tickframe.functions.numbers import close_enough, next_power_of_two, to_long

    text = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", to_long(text).alias("number"), next_power_of_two(F.col("o_orderkey")).alias("power"),
        close_enough(F.col("o_orderkey"), F.col("o_custkey"), 100).alias("near"),
    )


def order_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_updates through the fold that follows arbitrary references."""
    rows = feed(spark, sf_dir).select(
        F.col("stock").alias("stock_locate"),
        F.col("seq").alias("msgcnt"),
        "type",
        F.coalesce("ref", F.when(F.col("type") == "A", F.col("order_id"))).alias("order_id"),
        F.when(F.col("type") == "U", F.col("order_id")).alias("new_order_id"),
        "side",
        "shares",
        "px",
    )
    return fold.fold(rows).select("seq", "stock", "side", "px", "qty", "is_replace", "old_px", "old_qty")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__.rstrip("_"): f
    for f in (
        feed_messages, type_counts, trades, symbols, order_updates, order_fold, skipped_messages, order_remaining, replace_chain, level_quantity,
        level_intervals, bbo, consolidated_bbo, worst_quotes, level_counts, inside_reported, inside_lines, inside_changed, published_inside, top_n_levels,
        price_levels_, level_to_price_, penny_book_bbo, book_depth, event_depth, book_depth_stats, event_depth_stats, depth_stats_by_symbol,
        interarrival, rate_steps, rate_histogram, rate_quantiles, arrival_quantiles, feed_stats, feed_statistics, live_statistics, depth_statistics, hist_integer, hist_cuts, hist_mean,
        hist_summary, index_percentile, text_formats, validation_flags, stop_after, sum_square, delay_series, conj_multiply, reductions,
        time_delay, time_delay_confidence, long_delay_sums, inside_grid, packet_table, mold_gaps, decode_roundtrip, file_inside, packet_inside, live_inside, invalid_messages,
        inside_statistics, spectrum, number_helpers, generic_reductions, pitch_roundtrip, trade_lines, directory_depth, inside_feed_statistics,
    )
}
