r"""Importance resampling towards a target, with word tries that live in a partition.

A feature is a run of consecutive words. Each task keeps a trie of words: a node is a run, its children the runs
one word longer. A node holds how often the run occurred and the state of CRC-32 after it, so that a longer run's
checksum goes on from its parent's; the checksum names the bucket. Tries are handed on as bucket totals, which
Spark sums. Buckets get gains, and every document is scored along the paths of a trie whose nodes have the gains
attached. A trie that reaches NODES nodes is handed on and begun anew, so that memory doesn't grow with the corpus.

What is drawn comes from one sort over all documents that may be: rows are dealt out by ranges of the score, each
task numbers its own, and the counts of the tasks before are added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tickframe.llm.common import partitions, spread, table, written

#: Words in the longest feature, buckets, documents drawn in percent, words that a document needs, seed.
LONGEST, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, 2024
#: Nodes of a trie.
NODES = 1 << 20
#: Bytes of a text whose words are in memory at once.
PIECE = 1 << 20
#: A-Z become lower case; what is no ASCII letter or digit, and ASCII, becomes a space.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    raw = text.encode("utf-8", "surrogatepass").translate(_WORDS)
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):  # at a space, so that no word is cut
            end = raw.rfind(b" ", at, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


class _Words(dict):
    """Words to nodes of depth 1; an unknown word becomes a node."""

    def __init__(self, trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.grown(zlib.crc32(word), word)
        return node


class Trie:
    """Runs of words as nodes, numbered from 0: CRC-32 states, and a value from each node's bucket."""

    def __init__(self, buckets: int = BUCKETS, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.words = _Words(self)
        self.deeper: dict[int, int] = {}
        self.states: list[int] = []
        self.texts: list[bytes] = []
        #: bucket of each node, and its gain where there are gains
        self.values: list[int] = []
        self.seen = np.zeros(1024, np.int64)

    def grown(self, state: int, word: bytes) -> int:
        self.states.append(state)
        self.texts.append(word)
        bucket = state % self.buckets
        self.values.append(bucket if self.gains is None else int(self.gains[bucket]))
        return len(self.states) - 1

    def paths(self, text: str, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """Nodes of all runs of at most longest words, in parts of one depth each."""
        rest = np.zeros(0, np.int64)  # the last longest - 1 words of the part before
        for words in pieces(text):
            fresh = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            yield 1, fresh
            ones = np.concatenate([rest, fresh])
            level = ones
            for n in range(2, longest + 1):
                if len(ones) < n:
                    break
                pairs, of = np.unique((level[: len(ones) - n + 1] << 32) | ones[n - 1 :], return_inverse=True)
                level = np.array([self.child(p) for p in pairs.tolist()], np.int64)[of]
                # runs inside the rest were counted with the part before
                yield n, level[max(0, len(rest) - n + 1) :]
            rest = ones[len(ones) - longest + 1 :] if longest > 1 else rest

    def child(self, pair: int) -> int:
        node = self.deeper.get(pair)
        if node is None:
            word = self.texts[pair & 0xFFFFFFFF]
            node = self.deeper[pair] = self.grown(zlib.crc32(b" " + word, self.states[pair >> 32]), word)
        return node

    def counts(self, nodes: np.ndarray, n: np.ndarray) -> None:
        """Adds how often distinct nodes occurred."""
        if len(self.seen) < len(self.states):
            self.seen = np.append(self.seen, np.zeros(2 * len(self.states) - len(self.seen), np.int64))
        self.seen[nodes] += n

    def full(self) -> bool:
        return len(self.states) >= NODES


def totals(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features in it, of all texts; buckets without features are missing."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie = Trie(buckets)

        def out():
            sums = np.zeros(buckets, np.int64)
            np.add.at(sums, np.array(trie.values, np.int64), trie.seen[: len(trie.values)])
            some = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

        for batch in batches:
            for value in batch.column(0):
                for _, nodes in trie.paths(value.as_py() or "", longest):
                    found, n = np.unique(nodes, return_counts=True)
                    trie.counts(found, n)
                if trie.full():
                    yield out()
                    trie = Trie(buckets)
        yield out()

    return texts.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of all buckets: floor of 1000 times the logarithm of how much likelier the target is to use the bucket.

    raw and target are totals(); one is added to each of their buckets.
    """
    spark = raw.sparkSession
    sums = {name: df.agg(F.sum("n")).first()[0] or 0 for name, df in (("raw", raw), ("target", target))}
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, df in (("s", raw), ("t", target)):
        both = both.join(df.withColumnRenamed("n", name), "bucket", "left")
    add = lambda c, n: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("double") + F.lit(float(n))
    ratio = (add("t", 1) * add(F.lit(sums["raw"]), buckets)) / (add("s", 1) * add(F.lit(sums["target"]), buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """key, n_words, n_features and weight, the sum of the gains of its features, per row. gain has a row per bucket."""
    table_ = np.zeros(buckets, np.int64)
    for r in gain.collect():  # as many rows as buckets
        table_[r["bucket"]] = r["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(table_)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie, values = Trie(buckets, shared.value), np.zeros(0, np.int64)
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for value in batch.column(1):
                size = n = weight = 0
                for depth, nodes in trie.paths(value.as_py() or "", longest):
                    if len(values) < len(trie.values):
                        values = np.concatenate([values, np.array(trie.values[len(values) :], np.int64)])
                    weight += int(values[nodes].sum())
                    n += len(nodes)
                    size += len(nodes) if depth == 1 else 0
                for column, x in zip(out, (size, n, weight), strict=True):
                    column.append(x)
                if trie.full():
                    trie, values = Trie(buckets, shared.value), np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], ["key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "key long, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def luck(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number that seed and key alone decide, rounded down; null keys share one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """rows with rank, 1, 2, 3... in the given order, null beyond most. order must decide between all rows that differ.

    One sort by range; no task numbers the rows of another. rows should be a written table.
    """
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("at", LongType())])

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "at"])
            at += n

    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    numbered = written(ranged.mapInArrow(number, schema), "ranked")
    sizes = sorted((r["part"], r["count"]) for r in numbered.groupBy("part").count().collect())  # a row per task of the sort
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, before long"))
    rank = F.col("at") + F.col("before")
    return numbered.join(starts, "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "at", "before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    percent: int = PERCENT, least: int = LEAST, seed: int = SEED,
) -> DataFrame:
    """key, n_words, n_features, weight, score and rank per row of docs; those with a rank are the sample, best first.

    score is the weight plus a number drawn for the key. Of the documents of at least `least` words, percent are
    drawn. Null and empty texts have no words and weight 0. Rows of one key share their luck, not their weight;
    null keys share one and come last among equals. Equal scores go by key, then by the fewer features and the
    smaller weight; rows that are equal in all of these are interchangeable. Without target texts all gains come
    from docs alone; empty docs give an empty result. Other columns are ignored, whatever their names.
    """
    raw, aimed = (written(totals(df, text, longest, buckets), "totals") for df in (docs, target))  # rows by bucket
    gain = gains(raw, aimed, buckets)
    scored = weights(docs, gain, key, text, longest, buckets).withColumn("score", F.col("weight") + luck(F.col(key), seed))
    scored = written(scored, "scored")
    able = scored.where(F.col("n_words") >= least)
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("weight")]
    drawn = ranked(able, order, percent * able.count() // 100)
    return drawn.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return resample(docs, table(spark, sf_dir, "benchmark")).drop("n_words")


def _sql() -> str:
    from tickframe.llm.prefix_trie import CRC

    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    digits = "list_transform(range(1, len(x), 2), lambda i: (position(x[i] IN '0123456789ABCDEF') - 1) * 16 + position(x[i + 1] IN '0123456789ABCDEF') - 1)"
    return f"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
aimed AS (SELECT unnest({words}) AS word FROM benchmark),
spoken AS (SELECT row, unnest(w) AS word FROM split),
known AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM spoken UNION SELECT word FROM aimed)),
buckets AS (SELECT word, {CRC.format(bytes=digits)} % 10000 AS bucket FROM known),
raw AS (SELECT bucket, count(*) AS s FROM spoken JOIN buckets USING (word) GROUP BY ALL),
target AS (SELECT bucket, count(*) AS t FROM aimed JOIN buckets USING (word) GROUP BY ALL),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM spoken) + 10000)::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aimed) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN raw USING (bucket) LEFT JOIN target USING (bucket)
), weighed AS (SELECT row, sum(gain)::BIGINT AS weight FROM spoken JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE + 0.5)
      / 4294967296))))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (row)
), drawn AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM drawn) THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN drawn USING (row)
"""


SQL = _sql()
