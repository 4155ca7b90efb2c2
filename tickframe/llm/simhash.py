"""SimHash fingerprints with DataFrame functions only.

Terms are shingles of five lower-cased words (the whole text where it has fewer), weighted by how often
they occur. The 64 bits of a term's hash vote; a fingerprint's bit is set where more than half of the
weight votes for it. Votes are summed in 32 columns of two 32-bit lanes each, so that a shingle costs 32
additions inside generated code. Permuted block tables find all fingerprints within a Hamming radius.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.llm.common import WORD, partitions, table, written

SHINGLE = 5
RADIUS = 3
BLOCKS = 6
_LANES = 0x0000000100000001


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, terms (the weight of all terms) and fingerprint (a long) for every text that has a word.

    keys must tell the rows apart. Rows whose text is null or without words are absent; they take the
    fingerprint 0 in what follows. A text may have up to 2^31 words; its votes are partly summed where it
    is read, and only 34 numbers per text are shuffled.
    """
    words = texts.select(*keys, F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)).alias("words"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0))))
    terms = words.where(F.size("words") > 0).select(*keys, "words", at.alias("at"))
    hashed = terms.select(*keys, F.xxhash64(*[F.get("words", F.col("at") + k) for k in range(SHINGLE)]).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES))).alias(f"v{k}") for k in range(32)]
    sums = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("terms"), *votes)
    bits = []
    for k in range(32):
        low = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"v{k}", 32)
        for count, bit in ((low, k), (high, k + 32)):
            bits.append(F.when(count * 2 > F.col("terms"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, "terms", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks - radius blocks: two fingerprints within the radius agree on one of them."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    block = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(blocks)]
    return [_signed(reduce(int.__or__, chosen)) for chosen in combinations(block, blocks - radius)]


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (query, fingerprint, distance) within the radius, of two tables with a fingerprint column.

    Equal fingerprints are one: pairs are between different values, or of a value with itself. Each value
    has one row in every block table, keyed by the bits of the table's blocks; a pair comes from the first
    table on which it agrees, so none comes twice. With six blocks and radius 3 a key has about 32 bits.
    Blocks must outnumber the radius.
    """
    masks = _masks(radius, blocks)

    def tables(df: DataFrame, name: str) -> DataFrame:
        values = df.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct()
        rows = [F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]
        return values.select(name, F.explode(F.array(*rows)).alias("at")).select(name, "at.t", "at.key")

    differ = F.col("query").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    left, right = tables(queries, "query").alias("l"), tables(prints, "found").alias("r")
    condition = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key"))
    pairs = left.join(right, condition & (F.bit_count(differ) <= radius) & (first == F.col("l.t")))
    return pairs.select("query", F.col("found").alias("fingerprint"), F.bit_count(differ).alias("distance"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the text of the next one in descending order of the key; after the last comes the first.

    Returns bucket, place, extra, key, text, next_text. No task sorts everything: the keys are cut into
    buckets at keys that exist, and each bucket also gets, marked extra, the rows at which the next one
    starts. Null keys come last; equal keys go by text.
    """
    spark = docs.sparkSession
    low = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), low.alias("order"))
    n = 2 * partitions(spark)
    shares = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    bounds = rows.select(F.percentile_approx("order", shares, F.lit(100_000)).alias("cuts"), F.max("order").alias("most")).first()
    most = bounds["most"] if bounds["most"] is not None else 0
    cuts = sorted(set(bounds["cuts"] or []) - {most}, reverse=True)
    at = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.expr("cast(array() as array<bigint>)")
    # the number of cuts that are not below; without a lambda, so that Spark sees that two uses are the same shuffle
    bucket = len(cuts) + 1 - F.array_position(F.sort_array(F.array_append(at, F.col("order"))), F.col("order"))
    place = lambda b, extra: F.struct(b.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    copies = F.array(
        place(bucket, False),
        F.when(F.array_contains(at, F.col("order")), place(bucket - 1, True)),
        F.when(F.col("order") == most, place(F.lit(len(cuts)), True)),
    )
    dealt = rows.withColumn("to", F.explode(copies)).where("to is not null and to.bucket is not null").select("*", "to.bucket", "to.extra")
    in_order = Window.partitionBy("bucket").orderBy("extra", F.col("order").desc(), "text")
    return dealt.select(
        "bucket",
        F.row_number().over(in_order).alias("place"),
        "extra",
        key,
        "text",
        F.lead("text").over(in_order).alias("next_text"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and their neighbours; n_near for every row whose id is divisible by 100.

    n_near counts the rows of the table whose fingerprint is within three bits, the row itself included.
    """
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.length("text")
    moved = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - moved), F.substring("next_text", F.lit(1), moved))
    docs = docs.withColumn("edited", F.when(F.col("extra"), F.lit("")).otherwise(edited))
    keys = ["bucket", "place"]
    # both branches use the same columns, so that Spark shuffles the texts once
    both = docs.select(*keys, "doc_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    prints = fingerprints(both.select(*keys, "doc_id", "x.kind", "x.text"), [*keys, "doc_id", "kind"])
    wide = prints.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited"),
    )
    facts = docs.select(
        *keys, "extra", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    zero = F.lit(0).cast("long")
    joined = facts.join(wide, keys, "left").select(
        *facts.columns, F.coalesce("own", zero).alias("own"), F.coalesce("edited", zero).alias("edited")
    )
    following = F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    rows = written(
        joined.withColumn("following", following)
        .where(~F.col("extra"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            text("own").alias("fingerprint"),
            text("edited").alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("following")).alias("near_next"),
            "own",
        ),
        "simhash",
    )
    sizes = rows.groupBy(F.col("own").alias("fingerprint")).count()
    asked = F.col("doc_id") % 100 == 0
    queries = rows.where(asked).select(F.col("own").alias("fingerprint"))
    near = within(queries, sizes).join(sizes, "fingerprint").groupBy("query").agg(F.sum("count").alias("n_near"))
    # only rows that ask are joined, by their fingerprint; the others go on as they are
    answered = rows.where(asked).join(near, F.col("own") == F.col("query"), "left").drop("own", "query")
    return answered.unionByName(rows.where(~F.coalesce(asked, F.lit(False))).drop("own").withColumn("n_near", F.lit(None).cast("long")))
