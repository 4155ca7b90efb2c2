r"""A trie of conversations' beginnings, from chained digests.

Every turn has a digest of its own. A beginning of d turns is named by SHA-256 of the digest of the beginning
of d - 1 turns and of its last turn's digest, so that equal names mean equal beginnings. Every conversation is
exploded into all of its beginnings, and these are grouped by depth and digest to the trie's nodes.

A node belongs to the smallest conversation that passes it. The nodes of one conversation follow one another
down to its end, since whatever passes a deeper node passes those above. For sums over subtrees such a run is
summed from its end upwards first, and the sums, not each node for itself, are exploded to the nodes of the
conversation's path: as many rows as the conversation has beginnings, however deep it is. Copies own no nodes
and send nothing. All groups are summed in the tasks that read them before anything is shuffled.

Texts are shuffled once, to bring a conversation's turns in order; they are then digests. A conversation is
read turn by turn, never held, as is the list of those that end in a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.llm.common import partitions, table, written

#: The longest beginning taken over from another conversation, and how many neighbours share it.
SHARED, SIBLINGS = 9, 5
#: Conversations whose ids are joined to one string before they are hashed.
CHUNK = 4096
ROOT = hashlib.sha256(b"").digest()


def turns(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, n (the turn's number from 1), digest (of role and text, 32 bytes) and bytes (of the text) of every turn.

    Turns go by turn, null first, then by role and text. Null roles and texts are empty.
    """
    rows = messages.select(
        F.col(conv).cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where("conv is not null")
    number = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv", number.cast("long").alias("n"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def borrowed(own: DataFrame) -> DataFrame:
    """Rebuilt conversations: conv, part, n, digest, bytes; in the order of part and n.

    Conversation c begins with the first h turns of c - c % SIBLINGS, h being crc32 of its decimal id modulo
    SHARED, and goes on with its own turns after its first h. Part -1 is a row without turn for each conversation.
    """
    h = (F.crc32(F.col("conv").cast("string")) % SHARED).alias("h")
    known = own.where("n = 1").select("conv", h, (F.col("conv") - F.col("conv") % SIBLINGS).alias("host"))
    heads = own.where((F.col("n") < SHARED) & (F.col("conv") % SIBLINGS == 0)).withColumnRenamed("conv", "host")
    return (
        known.join(heads, "host")
        .where("n <= h")
        .select("conv", F.lit(0).alias("part"), "n", "digest", "bytes")
        .unionByName(own.withColumn("h", h).where("n > h").select("conv", F.lit(1).alias("part"), "n", "digest", "bytes"))
        .unionByName(
            known.select(
                "conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes")
            )
        )
    )


_BEGINNINGS = "conv long, depth int, node binary, parent binary, bytes long, ends boolean"


def beginnings(conversations: DataFrame) -> DataFrame:
    """Every beginning of every conversation, the empty one too: conv, depth, node, parent, bytes (of its last text), ends.

    conversations has the columns of borrowed(); ends marks the conversation's whole.
    """

    def chain(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv", "depth", "node", "parent", "bytes", "ends"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        last = None  # conv, depth, node, parent, bytes of the beginning before, whose end the next row tells
        for batch in batches:
            rows = []
            for conv, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv", "digest", "bytes")), strict=True):
                if digest is None:
                    now = (conv, 0, ROOT, None, 0)
                else:
                    now = (conv, last[1] + 1, hashlib.sha256(last[2] + digest).digest(), last[2], size)
                if last is not None:
                    rows.append((*last, last[0] != conv))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*last, True), kinds, strict=True)], names)

    dealt = conversations.repartition("conv").sortWithinPartitions("conv", "part", "n")
    return dealt.select("conv", "digest", "bytes").mapInArrow(chain, _BEGINNINGS)


def _ends(begun: DataFrame) -> DataFrame:
    """node and ends_sha256: SHA-256 of the ascending decimal ids of the conversations that end there, comma-joined."""

    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        node, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["node", "first", "ids"])

        for batch in batches:
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (at != node or len(ids) == CHUNK):
                    yield out()
                    ids = []
                node = at
                ids.append(conv)
        if ids:
            yield out()

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        node = state = None
        for batch in batches:
            nodes, digests = [], []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at == node:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = at, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    rows = begun.where("ends").select("node", "conv")
    ranged = rows.repartitionByRange(partitions(begun.sparkSession), "node", "conv").sortWithinPartitions("node", "conv")
    parts = ranged.mapInArrow(chunks, "node binary, first long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def trie(begun: DataFrame) -> DataFrame:
    """One row per node of the trie of beginnings().

    node, parent (digests), conv_id (smallest conversation that passes), depth, parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, bytes of the last text for each
    conversation but the first) and ends_sha256. begun should be a written table.
    """
    zero = F.lit(0).cast("long")
    passed = begun.select("depth", "node", "parent", "conv", "bytes", F.lit(1).cast("long").alias("convs"))
    nodes = passed.groupBy("depth", "node").agg(F.min("conv").alias("conv"), F.sum("convs").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("parent").alias("parent"))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node"), F.lit(1).cast("long").alias("child"))
    # nodes and their children's rows in one sum, so that a node of many children is summed where they are read
    counted = (
        nodes.withColumn("child", zero)
        .unionByName(children, allowMissingColumns=True)
        .groupBy("depth", "node")
        .agg(*(F.max(c).alias(c) for c in ("conv", "n_convs", "bytes", "parent")), F.sum("child").alias("n_children"))
    )
    counted = written(counted, "counted-nodes")
    own = counted.select(
        "conv", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    )
    upwards = Window.partitionBy("conv").orderBy(F.col("depth").desc())
    runs = begun.select("conv", "depth", "node").join(own, ["conv", "depth"], "left")
    sums = runs.select("depth", "node", F.sum("leaf").over(upwards).alias("leaves"), F.sum("saved").over(upwards).alias("saved")).where("leaves is not null")
    sums = sums.groupBy("depth", "node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # a run's nodes but its first have their parents in the run
    starts = Window.partitionBy("conv")
    headed = counted.withColumn("start", F.min("depth").over(starts))
    root = counted.where("depth = 0").select("conv").first()
    above = headed.where("depth = start and depth > 1").select("node", "parent")
    above = above.join(counted.select(F.col("node").alias("parent"), F.col("conv").alias("above")), "parent").select("node", "above")
    parent_conv = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, F.lit(root["conv"] if root else None)).when(
        F.col("depth") > F.col("start"), F.col("conv")
    )
    return (
        headed.join(above, "node", "left")
        .join(sums, ["depth", "node"])
        .join(_ends(begun), "node", "left")
        .select(
            "node",
            "parent",
            F.col("conv").alias("conv_id"),
            F.col("depth").cast("long").alias("depth"),
            F.coalesce(parent_conv, "above").cast("long").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
        )
    )


def prefix_trie(messages: DataFrame, conv: str = "conv_id", rebuilt: bool = False) -> DataFrame:
    """The trie of the conversations of messages (conv, turn, role, text); rebuilt: of borrowed() ones.

    Rows of null conversation are left out: nothing could name their nodes. Rows that repeat a turn are turns of
    their own, next to one another. Other columns are ignored, whatever their names; an empty table has no nodes.
    Texts of any length are hashed whole.
    """
    own = written(turns(messages, conv), "turns")
    plain = own.select("conv", F.lit(1).alias("part"), "n", "digest", "bytes")
    roots = own.where("n = 1").select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return trie(written(beginnings(borrowed(own) if rebuilt else plain.unionByName(roots)), "beginnings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), rebuilt=True).drop("node", "parent")


#: CRC-32 of a list of byte values, bit by bit.
CRC = """xor(list_reduce({bytes}, lambda c, b: list_reduce(range(8), lambda x, i:
  xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295)"""

SQL = f"""
WITH own AS (
  SELECT conv_id::BIGINT AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), known AS (
  SELECT conv, conv - conv % 5 AS host, {CRC.format(bytes="list_transform(string_split(conv::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 9 AS h
  FROM (SELECT DISTINCT conv FROM own)
), rebuilt AS (
  SELECT k.conv, 0 AS part, n, role, text FROM known k JOIN own o ON o.conv = k.host AND n <= h
  UNION ALL SELECT conv, 1, n, role, text FROM own JOIN known USING (conv) WHERE n > h
), begun AS (
  SELECT conv, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
         sha256(string_agg(sha256(role) || sha256(text), '' ) OVER w) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv ORDER BY part, n)
  UNION ALL SELECT conv, 0, 0, '' FROM known
), passed AS (
  SELECT *, max(depth) OVER (PARTITION BY conv) = depth AS ends, lag(node) OVER (PARTITION BY conv ORDER BY depth) AS parent FROM begun
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv) AS conv, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
         sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
  FROM passed GROUP BY ALL
), families AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT *, coalesce(n_children, 0) AS kids FROM nodes LEFT JOIN families USING (depth, node)),
sums AS (
  SELECT p.depth, p.node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE kids = 0) AS n_leaves
  FROM counted c JOIN passed p ON p.conv = c.conv AND p.depth <= c.depth GROUP BY ALL
)
SELECT c.conv AS conv_id, depth::BIGINT AS depth, up.conv AS parent_conv_id, c.n_convs::BIGINT AS n_convs, kids::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (depth, node) LEFT JOIN nodes up ON up.depth = c.depth - 1 AND up.node = c.parent
"""
