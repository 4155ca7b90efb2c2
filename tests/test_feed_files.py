"""Feed files in splits, writers with commit, captured packets as a stream, channels in sequence, more securities than locates."""

import gzip
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tickframe.plans import oracle, queries
from tickframe.plans.samples import MESSAGES
from tickframe.sources import capture, encode, frames, itch, sink
from tickframe.streaming import sequence

SAMPLES = [bytes.fromhex(x) for x in MESSAGES.values()]


def payloads(kind: str) -> list[bytes]:
    pick = random.Random(kind)
    fake = encode.framed([SAMPLES[8]] * 40)
    if kind == "real":
        return [pick.choice(SAMPLES) for _ in range(12_000)]
    if kind == "random":
        return [pick.randbytes(pick.randint(0, 300)) for _ in range(3_000)]
    if kind == "unknown":
        return [b"Z" + pick.randbytes(pick.randint(0, 60)) for _ in range(12_000)]
    # frames within payloads, frames longer than what an entry looks at, empty ones
    return [b"Z" + fake[pick.randint(0, 5) :] for _ in range(300)] + [pick.choice(SAMPLES) for _ in range(2_000)] + [b"Z" * 65_535] * 3 + [pick.randbytes(65_535)] * 4 + [b""] * 50


@pytest.mark.parametrize("kind", ["real", "random", "unknown", "adversarial"])
def test_splits_equal_a_scan(spark, tmp_path, kind):
    messages, at, want = payloads(kind), 0, []
    for k, m in enumerate(messages):
        want.append((k, at + 2, m[:1].decode("latin-1"), m))
        at += 2 + len(m)
    encode.write(str(tmp_path / "day.itch"), messages)
    raw = itch.read_itch(spark, f"file://{tmp_path}/day.itch", split_bytes=frames.LONGEST)
    assert raw.rdd.getNumPartitions() >= min(4, at // 80_000)
    assert sorted((r.msgcnt, r.msgoffset, r.type, bytes(r.payload)) for r in raw.collect()) == want
    assert raw.where("type in ('A', 'E')").select("msgcnt").count() == sum(m[:1] in (b"A", b"E") for m in messages)


def test_numbers_over_files(spark, tmp_path):
    for name, n in (("a", 3_000), ("b", 0), ("c", 1_000)):
        encode.write(str(tmp_path / f"{name}.itch"), SAMPLES[:1] * n)
    raw = itch.read_itch(spark, f"file://{tmp_path}", "msgcnt long", frames.LONGEST, numbered=True)
    assert sorted(r.msgcnt for r in raw.collect()) == list(range(4_000))
    (tmp_path / "c.itch").write_bytes(encode.framed(SAMPLES[:1] * 10)[:-3])
    with pytest.raises(Exception, match="cut off in message 3009"):
        itch.read_itch(spark, f"file://{tmp_path}", "msgcnt long", frames.LONGEST, numbered=True).collect()


def test_entry_is_a_guess_only():
    data = encode.framed(SAMPLES * 3)
    assert frames.entry(data) == 0 and frames.entry(b"\0\0\1" + data) == 3
    assert frames.entry(b"Z" * 5_000) is None and frames.entry(b"") is None


def test_writer_commits_what_succeeded(spark, tmp_path):
    """Two attempts of a task: only the one that is committed stays; an aborted job leaves nothing."""
    spark.dataSource.register(itch.ItchSource)
    rows = spark.range(0, 1000, 1, 4).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("m"))
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        rows.write.format("itch5").mode("append").save(path)
    assert itch.read_itch(spark, path).count() == 2000 and len(list((tmp_path / "out").iterdir())) == 8
    assert sorted({f.name.rsplit("-", 1)[1] for f in (tmp_path / "out").iterdir()}) == [f"{k:06d}.itch" for k in range(4)]
    rows.write.format("itch5").mode("overwrite").save(path)
    assert itch.read_itch(spark, path).count() == 1000
    broken = rows.select(F.when(F.col("m") == b"700", F.raise_error(F.lit("lost"))).otherwise(F.col("m")).alias("m"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("itch5").mode("append").save(path)
    assert itch.read_itch(spark, path).count() == 1000 and not (tmp_path / "out" / sink.TEMPORARY).exists()
    with pytest.raises(Exception, match="one column"):
        rows.withColumn("n", F.lit(1)).write.format("itch5").mode("append").save(path)


def test_attempts(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.types import StructType

    class Task:
        def partitionId(self):  # noqa: N802
            return 0

        def taskAttemptId(self):  # noqa: N802
            return 7

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task()))
    batch = pa.RecordBatch.from_arrays([pa.array([b"abc", None, b""])], ["m"])
    writer = sink.StreamWriter({"path": f"file://{tmp_path}"}, StructType.fromDDL("m binary"))
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))  # the first is lost, as is its executor
    writer.commit([second], 3)
    writer.commit([writer.write(iter([batch, batch]))], 3)  # the batch runs again after a restart
    found = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert [p.name for p in found] == ["batch-000000003-000000.itch"] and found[0].read_bytes() == encode.framed([b"abc", b""] * 2)
    assert (first.records, first.bytes) == (2, 7)


def test_lines(spark, tmp_path):
    spark.dataSource.register(itch.ItchSource)
    rows = spark.createDataFrame([("a",), (None,), ("é",)], "line string").coalesce(1)
    rows.write.format("itch5").options(records="lines", compression="gzip").mode("append").save(f"file://{tmp_path}/t")
    (file,) = (tmp_path / "t").iterdir()
    assert file.name.endswith(".txt.gz") and gzip.decompress(file.read_bytes()).decode() == "a\né\n"


def write_packets(path: Path, packets: list[tuple[int, bytes]], cut: int = 0) -> None:
    data = encode.framed([t.to_bytes(8, "big") + p for t, p in packets])
    path.write_bytes(data[: len(data) - cut])


def test_stream_goes_on_where_it_was(spark, tmp_path):
    """Files come and grow, the last one in the middle of a record; each record comes once, over restarts with one checkpoint."""
    spark.dataSource.register(capture.CaptureSource)
    folder = tmp_path / "in"
    folder.mkdir()
    of = lambda a, b: [(k * 1_000_000, f"p{k}".encode()) for k in range(a, b)]

    def run() -> list[str]:
        stream = spark.readStream.format("capture").load(f"file://{folder}")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((bytes(r.data).decode() for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()), key=lambda x: int(x[1:]))

    write_packets(folder / "a.cap", of(0, 10), cut=4)
    assert run() == [f"p{k}" for k in range(9)]
    write_packets(folder / "a.cap", of(0, 15))
    write_packets(folder / "b.cap", of(15, 20))
    assert run() == [f"p{k}" for k in range(20)]
    assert run() == [f"p{k}" for k in range(20)]
    write_packets(folder / "b.cap", of(15, 30))
    assert run() == [f"p{k}" for k in range(30)]
    assert spark.read.format("capture").load(f"file://{folder}").count() == 30


def test_sequence(spark, tmp_path):
    """Shuffled packets over two channels, duplicates, blocks that never come, and blocks that come after they were given up."""
    spark.dataSource.register(capture.CaptureSource)
    folder = tmp_path / "in"
    folder.mkdir()
    pick = random.Random(3)
    packet = lambda session, k: encode.packet(session, k * 2, [f"{session}{k * 2}".encode(), f"{session}{k * 2 + 1}".encode()])
    lost = {"X": {5, 6, 20}, "Y": set()}

    def sent(a: int, b: int) -> list[tuple[int, bytes]]:
        rows = [((k + 10) * 100_000, packet(s, k)) for s in "XY" for k in range(a, b) if k not in lost[s] for _ in range(pick.randint(1, 2))]
        return sorted(rows, key=lambda r: r[0] + pick.randint(0, 500_000))

    def run() -> dict[str, list[tuple]]:
        blocks = itch.blocks(spark.readStream.format("capture").load(f"file://{folder}"))
        out = sequence.sequenced(blocks, wait_ms=1_000, late="1 second")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
        return {s: sorted((r.seq, r.missing, None if r.payload is None else bytes(r.payload).decode()) for r in rows if r.session == s) for s in "XY"}

    write_packets(folder / "a.cap", sent(0, 30))
    run()
    write_packets(folder / "b.cap", sent(30, 60))
    run()
    # a packet that was given up comes after all, with others that let the time of the stream pass
    write_packets(folder / "c.cap", [(7_000_000, packet("X", 5)), *sent(60, 90)])
    got = run()
    want = [(k * 2 + j, 0, f"X{k * 2 + j}") for k in range(90) if k not in lost["X"] for j in range(2)] + [(10, 4, None), (40, 2, None)]
    assert got["X"] == sorted(want)
    assert got["Y"] == [(k, 0, f"Y{k}") for k in range(180)]


@pytest.mark.parametrize("name", ["file_inside", "packet_inside", "live_inside"])
def test_more_securities_than_locates(spark, data, tmp_path, name):
    """Securities whose locates are equal in two feeds keep books of their own."""
    events = spark.read.parquet(f"{data}/events.parquet")
    events.withColumn("user_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") - 1 + 65_536)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path)).select("seq", "stock", "bid_px", "bid_qty", "offer_px", "offer_qty")
    want = con.sql(oracle.SQL[name]).select("seq, stock, bid_px, bid_qty, offer_px, offer_qty").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_blocks_leave_in_pieces(spark, monkeypatch):
    """A batch of many packets leaves its task as batches of few blocks; none is lost or twice."""
    import pyarrow as pa

    monkeypatch.setattr(itch, "BLOCKS_AT_ONCE", 30)
    made = [encode.packet("S", 20 * k, [b"%d" % (20 * k + j) for j in range(20)]) for k in range(50)]
    packets = spark.createDataFrame([], "data binary")
    monkeypatch.setattr(type(packets), "mapInArrow", lambda self, function, schema: function)
    out = list(itch.blocks(packets)(iter([pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["data"])])))
    assert max(b.num_rows for b in out) <= 50
    assert [(s, p) for b in out for s, p in zip(b["seq"].to_pylist(), b["payload"].to_pylist(), strict=True)] == [(k, b"%d" % k) for k in range(1_000)]


def test_sequencer_asks_for_no_block_by_itself():
    """Blocks that come in turn cost the state no call each."""
    import pandas as pd

    class State(dict):
        calls = 0

        def containsKey(self, key):  # noqa: N802
            State.calls += 1
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

        def update(self, value):
            self["value"] = value

        def get(self):
            return self["value"]

        def exists(self):
            return "value" in self

    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    one = sequence.Sequencer(0, 1_000)
    one.next, one.timer, one.held = State(), State(), State()
    rows = pd.DataFrame({"seq": range(500), "payload": [b"x"] * 500, "received": pd.Timestamp("2024-01-01", tz="UTC")})
    (out,) = one.handleInputRows(("S",), iter([rows]), clock)
    assert out["seq"].tolist() == list(range(500)) and State.calls == 0


def test_sequencer_holds_little(monkeypatch):
    """Blocks ahead of their turn go to the state while others still come, and all leave in sequence, each once."""
    import pandas as pd

    class State(dict):
        calls, most = 0, 0

        def containsKey(self, key):  # noqa: N802
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            self[key], State.calls = value, State.calls + 1
            State.most = max(State.most, len(self))

        def getValue(self, key):  # noqa: N802
            return self[key]

        def removeKey(self, key):  # noqa: N802
            del self[key]

        def update(self, value):
            self["value"] = value

        def get(self):
            return self["value"]

        def exists(self):
            return "value" in self

    monkeypatch.setattr(sequence, "GATHERED", 1 << 14, raising=False)
    monkeypatch.setattr(sequence, "CHUNK", 1_000, raising=False)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    one = sequence.Sequencer(0, 1_000)
    one.next, one.timer, one.held = State(), State(), State()
    numbers = [list(range(200 * k, 200 * k + 250)) for k in reversed(range(100))]  # they overlap, and the first comes last
    frame = lambda seq: pd.DataFrame({"seq": seq, "payload": [b"%d" % k for k in seq], "received": pd.Timestamp("2024-01-01", tz="UTC")})
    early = []

    def rows():
        for k, seq in enumerate(numbers):
            if k == 50:
                early.append(len(one.held))
            yield frame(seq)

    out = pd.concat(list(one.handleInputRows(("S",), rows(), clock)))
    assert out["seq"].tolist() == list(range(20_050)) and out["payload"].tolist() == [b"%d" % k for k in range(20_050)]
    assert early[0] > 0 and not one.held and State.most < 1_000 and State.calls < 1_000


def test_packs(spark):
    """Rows by session, null too, with the newest time of a pack; nothing is lost."""
    import pyarrow as pa

    from tickframe.streaming import packs

    times = pa.array([5, 9, 2, 7, 1], pa.timestamp("us", "UTC"))
    columns = {"session": ["X", "Y", None, "X", "Y"], "seq": [3, 1, 0, 4, 2], "received": times, "payload": [b"c", b"a", None, b"d", b"b"]}
    (out,) = packs.packed(iter(pa.table(columns).to_batches()), "session", pa.string(), sequence.PACK, "received")
    got = {s: (at.value, packs.rows_of([p], sequence.PACK).select(["seq", "payload"]).to_pylist()) for s, at, p in zip(out["session"].to_pylist(), out["at"], out["pack"].to_pylist(), strict=True)}
    row = lambda seq, payload: {"seq": seq, "payload": payload}
    assert got == {"X": (7, [row(3, b"c"), row(4, b"d")]), "Y": (9, [row(1, b"a"), row(2, b"b")]), None: (2, [row(0, None)])}


def test_live_books_ask_once_for_a_security():
    """Orders of a security come from the state and go there as one value; ids have all their 64 bits."""
    import pyarrow as pa

    from tickframe.streaming import live, packs

    class State(dict):
        calls = 0

        def containsKey(self, key):  # noqa: N802
            State.calls += 1
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            State.calls += 1
            self[key] = value

        def getValue(self, key):  # noqa: N802
            State.calls += 1
            return self[key]

        def removeKey(self, key):  # noqa: N802
            State.calls += 1
            del self[key]

    import pandas as pd

    high, books = 1 << 60, live.LiveBooks()
    books.books = State()

    def quotes(*messages):
        rows = pa.Table.from_pylist([dict(zip(live.PACK.names, m, strict=True)) for m in messages], live.PACK)
        (frame,) = books.handleInputRows((0,), iter([pd.DataFrame({"pack": [packs.bytes_of(rows)]})]), None)
        return frame[["stock", "seq", "qty", "bid_px", "bid_qty"]].values.tolist()

    adds = [(7, k, "A", high + k, None, "B", 10, 100 + k) for k in range(300)]
    assert quotes(*reversed(adds))[-1] == [7, 299, 10, 399, 10] and State.calls == 2
    replaced = (7, 300, "U", high + 299, high + 1_001, None, 20, 500)
    assert quotes(replaced, (8, 0, "A", 1, None, "B", 5, 9)) == [[7, 300, 20, 500, 20], [8, 0, 5, 9, 5]]
    assert quotes((7, 301, "D", high + 1_001, None, None, None, None)) == [[7, 301, -20, 398, 10]]
    assert quotes((8, 1, "X", 1, None, None, 5, None)) == [[8, 1, -5, 0, 0]] and list(books.books) == [(7,)]
