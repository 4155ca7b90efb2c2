"""Messages into packets: coalesced until a packet is full or the feed pauses, and the gaps of received packets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER, BLOCK_HEADER, MOST_BLOCKS = 20, 2, 65_535
MTU, DELAY_NS = 508, 100_000


def packetize(messages: DataFrame, session: str, seq: str, time: str, size: str, mtu: int = MTU, delay: int = DELAY_NS) -> DataFrame:
    """session, seq, size, first_seq: the packet of each message, named by its first message.

    A packet closes before a message that would fill it to the mtu, and before one that comes delay or more
    after the last packet was sent. Packets follow one another within a session, the unit of parallel work;
    its messages stream through the task in order and the state is three numbers.
    """
    if not 20 <= mtu < 65_535 or delay <= 0:
        raise ValueError("mtu in [20, 65535), delay above 0")

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, first, held, blocks, sent = None, 0, HEADER, 0, 0
        for batch in batches:
            packet = []
            for key, k, t, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if own is None or key != own[0]:
                    own, first, held, blocks, sent = (key,), k, HEADER, 0, t
                late = t - sent >= delay
                full = held + n + BLOCK_HEADER >= mtu or blocks == MOST_BLOCKS
                if blocks and (late or full):
                    sent, blocks, held = t, 0, HEADER
                if not blocks:
                    first = k
                blocks += 1
                held += n + BLOCK_HEADER
                packet.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(packet, pa.int64())], ["session", "seq", "size", "first_seq"])

    kind = dict(messages.dtypes)[session]
    rows = messages.select(F.col(session).alias("session"), F.col(seq).cast("long").alias("seq"), F.col(time).cast("long"), F.col(size).cast("long"))
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(fold, f"session {kind}, seq long, size long, first_seq long")


def packet_table(messages: DataFrame, session: str, seq: str, time: str, size: str, mtu: int = MTU, delay: int = DELAY_NS) -> DataFrame:
    """session, first_seq, block_count, bytes; the last, partial packet of a session is there too, marked is_final_partial."""
    packets = packetize(messages, session, seq, time, size, mtu, delay).groupBy("session", "first_seq").agg(
        F.count(F.lit(1)).alias("block_count"), (F.sum(F.col("size") + BLOCK_HEADER) + HEADER).cast("long").alias("bytes")
    )
    return packets.withColumn("is_final_partial", F.lead("first_seq").over(Window.partitionBy("session").orderBy("first_seq")).isNull())


def gaps(packets: DataFrame, session: str, arrival: str, first: str, count: str) -> DataFrame:
    """Packets in order of arrival with expected (the number after the last packet before) and gap (first less expected).

    0 is no gap, above 0 messages are missing, below 0 they came before. The first packet expects number 0.
    """
    before = Window.partitionBy(session).orderBy(arrival)
    expected = F.coalesce(F.lag(F.col(first) + F.col(count)).over(before), F.lit(0)).cast("long")
    return packets.withColumn("expected", expected).withColumn("gap", F.col(first) - F.col("expected"))
