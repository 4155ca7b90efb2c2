r"""Exact Jaccard links between documents on word shingles, by prefix filters under several token orders.

Equal sets are one. What is left goes through these steps:

1. Shingles, as 64-bit hashes, are shuffled in blocks by hash range and counted; those that only one set
   has link nothing and stay behind as a number. Very frequent ones, which tasks notice while they read all
   texts, are not gathered to be counted: every order has them last.
2. Under an order of all tokens by rising frequency, two sets of similarity t share a token among the
   first n - ceil(t n) + 1 of each. This holds under any order that all sets share, so the prefixes under
   three orders (by frequency and hash, by frequency and another hash, by the frequency's power of two and
   a third hash) are kept, and a candidate pair must meet in all three.
3. In a few rounds each set is compared with three sets that it meets, chosen by hash, which joins large groups
   of near copies without their pairs; then all candidates that are still in different components are compared.

Every candidate is verified on its whole sets. The links' components come from tickframe.llm.graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import fitted, partitions, small, spread, table, written
from tickframe.llm.graph import components

SHINGLE = 5
PERCENT = 75
#: Tokens that one task of the count takes, about, 15 bytes each, and that one of the prefixes takes, 24 bytes each.
RANGE_TOKENS, BUCKET_TOKENS = 2_000_000, 500_000
#: A token that is in so many sets, or in a 2^HOT_SHARE-th of all tokens if that is more, isn't counted in one task; a
#: task reports what it saw HOT_LOCAL times among HELD tokens. There are at most 2^HOT_SHARE hot tokens, 8 bytes each.
HOT_SETS, HOT_SHARE, HOT_LOCAL = 250_000, 20, 8
#: In joins by token, a token with so many rows, or with a 512th of all if that is more, is dealt to SALTS tasks.
HEAVY, SALTS = 1_000, 32
#: Rounds in which documents that are apart are compared with STARS others that they meet; the rounds end
#: early when the pairs left are at most FEW times the rows, or two rounds found no link.
TURNS = 3
STARS = 3
FEW = 2
#: Ids up to this many (8 bytes each) are broadcast.
BROADCAST_IDS = 500_000
#: Tokens that a task holds before it hands them on.
HELD = 1_500_000
#: Bytes of a token that its range doesn't tell; ranges have at least as many bits as the rest.
LOW = 7
#: Distinct words whose hashes a task keeps.
MEMO = 1 << 18
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53],
    np.uint64,
)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers, another one for each salt."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes, sorted, with a bounded memory of word hashes."""

    def __init__(self, size: int = SHINGLE):
        import xxhash

        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO:
                    self.clear()
                self[word] = got = xxhash.xxh64_intdigest(word)
                return got

        self.size, self.memo = size, Memo()
        self.factors = mix(np.arange(1, size + 2, dtype=np.uint64) * _ODD[0]) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        split = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        n = min(len(split), self.size)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.array(list(map(self.memo.__getitem__, split)), np.uint64)
        last = len(h) - n + 1
        total = np.full(last, n, np.uint64) * self.factors[self.size]
        for k in range(n):
            total += h[k : k + last] * self.factors[k]
        return np.unique(mix(total))


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc, n (distinct shingles) and s1, s2 (128 bits that equal sets share), a row per row of docs; and rows of frequent tokens.

    The latter have null in s2, a token in s1 and how many different sets of a part of a task had it in n.
    """

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        own = Shingler(size)
        sets: dict[int, np.ndarray] = {}
        held = 0

        def batch_of(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "n", "s1", "s2"])

        def frequent():
            token, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            often = count >= HOT_LOCAL
            sets.clear()
            none = np.full(int(often.sum()), None)
            return batch_of(none, count[often], token[often].view(np.int64), none)

        for batch in batches:
            n, one, two = [], [], []
            for value in batch.column(1):
                found = own(value.as_py())
                whole = xxhash.xxh3_128_intdigest(found.tobytes())
                n.append(len(found))
                one.append((whole >> 64) - (1 << 63))
                two.append((whole & (1 << 64) - 1) - (1 << 63))
                if len(found) and whole not in sets:
                    sets[whole] = found
                    held += len(found)
                if held > HELD:
                    yield frequent()
                    held = 0
            yield batch_of(batch.column(0), n, one, two)
        if sets:
            yield frequent()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(scan, "doc long, n long, s1 long, s2 long")


def _blocks(docs: DataFrame, size: int, bits: int, hot: np.ndarray) -> DataFrame:
    """Tokens by range of their hash, in blocks: r; ids, n and counts of documents; the low LOW bytes of tokens.

    Hot tokens are in blocks of their own, whole, with a range below 0 that their document picks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Shingler(size)

        hot = shared.value

        def block(ids: list[int], sets: list[np.ndarray]):
            tokens, key = np.concatenate(sets), np.array(ids, np.int64)
            n = np.array([len(s) for s in sets], np.int32)
            of = np.repeat(np.arange(len(ids), dtype=np.int32), n)
            r = (tokens >> np.uint64(64 - bits)).astype(np.int32)
            if len(hot):
                often = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                r[often] = -1 - (mix(key.view(np.uint64), 5) >> np.uint64(64 - bits)).astype(np.int32)[of[often]]
            order = np.argsort(r, kind="stable")
            tokens, of, r = tokens[order], of[order], r[order]
            heads = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (of[1:] != of[:-1])]))
            counts = np.diff(np.append(heads, len(r))).astype(np.uint32)
            bytes_ = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)
            rows: list[list] = [[], [], [], [], []]
            edges = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for a, b in zip(edges, np.append(edges[1:], len(r)), strict=True):
                x, y = np.searchsorted(heads, [a, b])
                docs_ = of[heads[x:y]]
                low = bytes_[a:b, : LOW if r[a] >= 0 else 8].tobytes()
                for column, value in zip(rows, (int(r[a]), key[docs_].tobytes(), n[docs_].tobytes(), counts[x:y].tobytes(), low), strict=True):
                    column.append(value)
            kinds = [pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["r", "ids", "n", "counts", "tokens"])

        ids, sets, held = [], [], 0
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(found := own(value.as_py())):
                    ids.append(k)
                    sets.append(found)
                    held += len(found)
                if held > HELD:
                    yield block(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield block(ids, sets)

    return docs.mapInArrow(scan, "r int, ids binary, n binary, counts binary, tokens binary")


def _shared(bits: int, buckets: int):
    """Of a range's tokens those of two documents or more, with their frequency, in blocks by bucket of documents."""

    def count(group):
        import pyarrow as pa

        join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        counts = join("counts", np.uint32)
        doc, n = np.repeat(join("ids", np.int64), counts), np.repeat(join("n", np.int32), counts)
        r = group.column("r")[0].as_py()
        if r >= 0:
            low = join("tokens", np.uint8).reshape(-1, LOW)
            tokens = np.zeros((len(low), 8), np.uint8)
            tokens[:, :LOW] = low
            tokens = tokens.view("<u8").ravel() | (np.uint64(r >> bits - 8 * (8 - LOW)) << np.uint64(8 * LOW))
        else:
            tokens = join("tokens", np.uint64)
        order = np.lexsort((doc, tokens)) if len(tokens) else np.zeros(0, np.int64)
        tokens, doc, n = tokens[order], doc[order], n[order]
        once = np.ones(len(tokens), bool)  # a repeated row has its tokens once
        once[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
        tokens, doc, n = tokens[once], doc[once], n[once]
        heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, len(tokens)))
        df = np.repeat(sizes, sizes) if r >= 0 else np.full(len(tokens), 2**32 - 1, np.int64)
        keep = df > 1
        tokens, doc, n, df = tokens[keep], doc[keep], n[keep], df[keep]
        bucket = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tokens, doc, n, df, bucket = tokens[order], doc[order], n[order], df[order], bucket[order]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(bucket))
        cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(edges, ends, strict=False)], pa.binary())
        return pa.table(
            [pa.array(bucket[edges], pa.int32()), cut(doc, np.int64), cut(n, np.int32), cut(tokens, np.uint64), cut(np.minimum(df, 2**32 - 1), np.uint32)],
            ["b", "ids", "n", "tokens", "df"],
        )

    return count


def _prefixes(percent: int):
    """For each document: its shared tokens, and its prefixes under the three orders; documents without a prefix go."""

    def cut(group):
        import pyarrow as pa

        join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        doc, n, tokens, df = join("ids", np.int64), join("n", np.int32), join("tokens", np.uint64), join("df", np.uint32)
        out: list[list] = [[] for _ in range(6)]
        orders = [
            np.lexsort((mix(tokens, 1), df, doc)),
            np.lexsort((mix(tokens, 2), df, doc)),
            np.lexsort((mix(tokens, 3), np.log2(np.maximum(df, 1)).astype(np.int8), doc)),
        ]
        by_doc = doc[orders[0]]
        heads = np.flatnonzero(np.concatenate([[True], by_doc[1:] != by_doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        for a, b in zip(heads, np.append(heads[1:], len(doc)), strict=False):
            own = orders[0][a:b]
            size = int(n[own[0]])
            # tokens that no other set has come first under each order
            length = size - (percent * size + 99) // 100 + 1 - (size - len(own))
            if length <= 0:
                continue
            first, second, third = (tokens[o[a:b][:length]] for o in orders)
            row = (int(doc[own[0]]), size, np.sort(tokens[own]).tobytes(), first.view(np.int64), *(_short(x) for x in (second, third)))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc", "n", "tokens", "p1", "p2", "p3"])

    return cut


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token: enough for a filter, which may pass too much but never too little."""
    return mix(tokens, 4).astype(np.uint32).view(np.int32)


def _verified(pairs: DataFrame, cands: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that pass the second and third order, the sizes, and the exact comparison."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, na, nb = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (na[k] + nb[k] - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"]
            )

    side = lambda s: cands.select(
        F.col("doc").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"t{s}"), F.col("p2").alias(f"p2{s}"), F.col("p3").alias(f"p3{s}")
    )
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = (F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100) & F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")
    return joined.where(fits).select("a", "b", "na", "nb", "ta", "tb").mapInArrow(verify, "a long, b long")


def links(
    docs: DataFrame, total: int, hot: np.ndarray, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Links (a, b) whose components are those of all links; docs holds different sets, total is the sum of their sizes, hot has frequent tokens, sorted."""
    n = partitions(docs.sparkSession)
    # both follow the tokens; a setting only makes them finer
    bits = max(8 * (8 - LOW), min(30, (max(total // RANGE_TOKENS, n) - 1).bit_length()))
    buckets = min(1 << 30, max(total // BUCKET_TOKENS, 4 * n))
    blocks = _blocks(docs.select(F.col(key).cast("long"), text), size, bits, hot)
    shared = blocks.groupBy("r").applyInArrow(_shared(bits, buckets), "b int, ids binary, n binary, tokens binary, df binary")
    cands = written(
        shared.groupBy("b").applyInArrow(
            _prefixes(percent), "doc long, n int, tokens binary, p1 array<long>, p2 array<int>, p3 array<int>"
        ),
        "candidates",
    )
    at = F.posexplode("p1").alias("at", "token")
    members = cands.select("doc", "n", (F.col("n") - F.octet_length("tokens") / 8).cast("int").alias("alone"), at).select(
        "doc", "n", "alone", (F.col("alone") + F.col("at")).alias("at"), "token"
    )
    rows = members.count()
    known = docs.sparkSession.createDataFrame([], "node long, component long")
    misses = 0
    for turn in range(TURNS):
        open_, heavy = _apart(members, known, rows)
        rows, pairs = _pairs(open_, rows)
        if pairs <= FEW * rows or misses == 2:
            break
        # who is together stays together: later turns only see what is open now
        members = open_.select("doc", "n", "alone", "at", "token")
        stars = [_star(open_, heavy, salt, percent) for salt in range(STARS * turn, STARS * (turn + 1))]
        chosen = written(fitted(_union(stars).distinct(), rows), "star-pairs")
        new = written(_verified(chosen, cands, percent), "star-links")
        if new.isEmpty():
            misses += 1
            continue
        misses = 0
        known = components(_stars(known).unionByName(new))
    else:
        open_, _ = _apart(members, known, rows)
    # a pair is made at the first token of its prefixes that both have
    firsts = F.slice("p1", F.lit(1), F.col("at") - F.col("alone"))
    open_ = written(fitted(open_.join(cands.select("doc", "p1"), "doc").select(*open_.columns, firsts.alias("before")), rows), "open-prefixes")
    left, right = open_.alias("l"), open_.alias("r")
    # what two sets of these sizes have in common at least, and at most if this token is their first in common
    needed = (F.col("l.n") + F.col("r.n")) * percent / (100 + percent)
    possible = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at"))
    meets = (
        (F.col("l.token") == F.col("r.token"))
        & (F.col("l.doc") < F.col("r.doc"))
        & (F.col("l.component") != F.col("r.component"))
        & (F.greatest("l.n", "r.n") * percent <= F.least("l.n", "r.n") * 100)
        & (possible >= needed)
        & ~F.arrays_overlap("l.before", "r.before")
    )
    pairs = left.join(right, meets).select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b"))
    return _stars(known).unionByName(_verified(pairs, cands, percent))


def _stars(known: DataFrame) -> DataFrame:
    """Links that have the given components."""
    return known.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _apart(members: DataFrame, known: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Members with their component, of the tokens where several components meet, and the tokens of most rows; written tables."""
    placed = members.join(known, members["doc"] == known["node"], "left").select(
        "token", "doc", "n", "alone", "at", F.coalesce("component", "doc").alias("component")
    )
    placed = written(fitted(placed, rows), "placed")
    tokens = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
    tokens = written(fitted(tokens.where("x < y").select("token", "size"), rows), "tokens")
    heavy = F.broadcast(tokens.where(F.col("size") > max(HEAVY, rows // 512)).select("token", F.lit(SALTS).alias("salts")))  # 512 rows at most
    return written(fitted(_by_token(placed, tokens.select("token"), heavy), rows), "open"), heavy


def _by_token(members: DataFrame, tokens: DataFrame, heavy: DataFrame) -> DataFrame:
    """members joined with a table of one row per token; the rows of heavy tokens are dealt out by document."""
    salts = F.coalesce("salts", F.lit(1))
    left = members.join(heavy, "token", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), salts)).drop("salts")
    right = tokens.join(heavy, "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).drop("salts")
    return left.join(right, ["token", "salt"]).drop("salt")


def _pairs(open_: DataFrame, rows: int) -> tuple[int, int]:
    """Rows, and pairs of rows that share a token across components."""
    sizes = open_.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("size"))
    sums = fitted(sizes.groupBy("token").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("own")), rows)
    row = sums.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
    return int(row[0] or 0), int(row[1] or 0)


def _star(open_: DataFrame, heavy: DataFrame, salt: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents with one that they meet in another component, the first of a token by a salted hash."""
    order = lambda *c: F.xxhash64(*c, F.lit(salt))
    leaders = open_.groupBy("token").agg(
        F.min(F.struct(order("doc").alias("h"), F.col("doc").alias("leader"), F.col("component").alias("other"), F.col("n").alias("m"))).alias("x")
    )
    met = _by_token(open_, leaders.select("token", "x.leader", "x.other", "x.m"), heavy).where(
        (F.col("component") != F.col("other")) & (F.greatest("n", "m") * percent <= F.least("n", "m") * 100)
    )
    one = met.groupBy("doc").agg(F.min(F.struct(order("leader").alias("h"), "leader")).alias("x"))
    return one.select(F.least("doc", "x.leader").alias("a"), F.greatest("doc", "x.leader").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) for every row of docs.

    Null, empty and blank texts have no shingles and are linked with nothing, and neither are rows whose key
    is null. Fewer words than a shingle make one shingle of all words. A key stands for one document: rows
    may repeat it with an equal text. Other columns are ignored; an empty table gives an empty result.
    """
    read = written(shingle_sets(docs, key, text, size), "sets")
    sets = read.where("s2 is not null")
    real = sets.where("n > 0 and doc is not null")
    groups = real.groupBy("s1", "s2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    groups = written(groups, "equal-sets")
    rows = sets.join(small(groups, BROADCAST_IDS), ["s1", "s2"], "left").select(
        "doc", "n", F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("first", "doc")).otherwise(F.col("doc")).alias("first")
    )
    rows = written(rows, "representatives")
    copies = written(rows.where("doc <> first").select(F.col("doc").alias(key)), "copies")
    total = rows.where("doc = first").agg(F.sum("n")).first()[0] or 0
    own = docs.where(F.col(key).isNotNull()).join(small(copies, BROADCAST_IDS), key, "left_anti")
    often = read.where("s2 is null").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_SETS, total >> HOT_SHARE))
    hot = np.sort(np.array([r["s1"] for r in often.select("s1").collect()], np.int64).view(np.uint64))
    known = components(links(own, total, hot, key, text, size, percent))
    return rows.join(small(known, BROADCAST_IDS), rows["first"] == known["node"], "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id")
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT row, array_to_string(w[s : s + 4], ' ') AS shingle
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM docs WHERE len(w) > 0)
), sizes AS (SELECT row, count(*)::BIGINT AS n FROM shingles GROUP BY row),
common AS (
  SELECT a.row AS x, b.row AS y, count(*) AS same FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.row < b.row GROUP BY ALL
), links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM common JOIN sizes u ON u.row = x JOIN sizes v ON v.row = y
  JOIN docs p ON p.row = x JOIN docs q ON q.row = y WHERE 100 * same >= 75 * (u.n + v.n - same)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT DISTINCT doc_id AS root, doc_id AS node FROM docs
  UNION SELECT root, b FROM reached JOIN both_ways ON node = a
), least_ AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (row) LEFT JOIN least_ ON node = doc_id
"""
