r"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a batch of documents. Words that no benchmark item has end every match, so a shard's suffix
array covers the runs of benchmark words that are long enough; it is sorted by prefix doubling up to the
window's length. Every suffix of every test item is binary-searched in it, equal beginnings once, which gives
all places of its first ten words. Places that follow on one another make the spans. Where the longest verbatim
match is asked for, a suffix array over an affected document and its items gives it. Nothing is shuffled while the
benchmark fits one block; larger ones are searched block by block, and what the blocks found of a row is
merged by the row's number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import small, spread, table, written

WINDOW = 10
#: Benchmark text that travels to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Distinct beginnings of test suffixes that are searched at once.
SEARCHED = 1 << 16
#: Training text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Up to this many ids of affected documents are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Words of ASCII letters and digits and all other non-ASCII bytes; A-Z becomes lower case, the rest a space.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Windows:
    """The distinct beginnings, of one length, of the suffixes of a block's items, and where each occurs."""

    def __init__(self, words: np.ndarray, places: np.ndarray, item: np.ndarray, size: int):
        self.keys, of = np.unique(words[places[:, None] + np.arange(size)], axis=0, return_inverse=True)
        order = np.argsort(of.reshape(-1), kind="stable")
        self.places = places[order]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(of.reshape(-1), minlength=len(self.keys)))])
        self.items = item[self.places]

    def owners(self, window: int) -> np.ndarray:
        """Places in the items, in rising order."""
        return self.places[self.edges[window] : self.edges[window + 1]]


class Probe:
    """A block of test items: their words as numbers from 1, one after the other, and their suffixes' beginnings by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        parts: list[np.ndarray] = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.names.append(name)
                parts.append(np.array(ids, np.int32))
        self.window = window
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        joined = self.words = np.concatenate(parts or [np.zeros(0, np.int32)])
        item = np.repeat(np.arange(len(parts)), np.diff(self.starts))
        sizes = np.minimum(np.diff(self.starts), window)
        self.windows: dict[int, Windows] = {}
        for size in np.unique(sizes).tolist():
            first = np.arange(len(joined)) + size <= self.starts[item + 1]
            self.windows[size] = Windows(joined, np.flatnonzero(first & (sizes[item] == size)), item, size)
        self.shortest = min(self.windows, default=0)
        self.longest = max(self.windows, default=0)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of their suffixes, compared over at least depth numbers."""
    rank, k = text.astype(np.int64), 1
    while k < depth:
        ahead = np.zeros_like(rank)
        ahead[:-k or None] = rank[k:] if k < len(rank) else 0
        values, rank = np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        if len(values) == len(text):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the range of the suffix array whose suffixes start with it; a binary search for all keys at once."""
    padded = np.concatenate([text, np.zeros(keys.shape[1], text.dtype)])
    offsets = np.arange(keys.shape[1])

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(array), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            there = padded[array[np.minimum(middle, len(array) - 1)][:, None] + offsets]
            unlike = there != keys
            at = unlike.argmax(axis=1)
            rows = np.arange(len(keys))
            less = there[rows, at] < keys[rows, at]
            right = np.where(unlike.any(axis=1), less, after)
            low = np.where(open_ & right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    return bound(False), bound(True)


def _occurrences(text: np.ndarray, array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all keys in text, and which key it is, by place."""
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(keys), SEARCHED):
        low, high = search(text, array, keys[k : k + SEARCHED])
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        places.append(array[at])
        which.append(k + np.repeat(np.arange(len(counts)), counts))
    place, key = np.concatenate(places), np.concatenate(which)
    order = np.argsort(place, kind="stable")
    return place[order], key[order]


def _ranks(text: np.ndarray) -> np.ndarray:
    """The rank of every suffix of text among all of them, by prefix doubling until all differ."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while k < len(text) and int(rank.max()) < len(text) - 1:
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:] + 1
        rank = np.unique(rank * (len(text) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def _longest(text: np.ndarray, probe: Probe, items: np.ndarray) -> tuple[int, int, int, int]:
    """The longest match of a text's words with one of the items: words, place in the text, item, place in it; of equals the last.

    A suffix array over both, the longest common beginnings of neighbours in it, and for every suffix of the text
    the nearest suffix of an item on either side: n log n time, however often words repeat.
    """
    parts = [text.astype(np.int64), *(probe.words[probe.starts[i] : probe.starts[i + 1]].astype(np.int64) for i in items.tolist())]
    own = np.concatenate([np.append(p, 0) for p in parts])
    ends = own == 0
    own[ends] = -np.arange(1, ends.sum() + 1)  # each end, and each word that no item has, is like no other
    rank = _ranks(own)
    order = np.argsort(rank, kind="stable")
    # common beginnings with the next in order, by the text (Kasai's rule)
    values, ranks, at = own.tolist(), rank.tolist(), order.tolist()
    shared, h = [0] * len(values), 0
    for i, r in enumerate(ranks):
        if r + 1 == len(at):
            h = 0
            continue
        j = at[r + 1]
        while i + h < len(values) and j + h < len(values) and values[i + h] == values[j + h]:
            h += 1
        shared[r] = h
        h = max(0, h - 1)
    size = len(text)
    best = (0, 0, 0)
    # a run of neighbours that share at least the most words found so far
    near = np.zeros(len(at), np.int64)
    for step in (range(len(at)), range(len(at) - 1, -1, -1)):
        common = 0
        for r in step:
            if at[r] > size:
                common = len(values)
            elif common:
                near[r] = max(near[r], common)
            common = min(common, shared[r] if step.step == 1 else shared[r - 1] if r else 0)
    most = int(near.max(initial=0))
    if not most:
        return (0, 0, 0, 0)
    place = int(order[near == most].max())
    # all that begin with the same words are neighbours
    low = high = ranks[place]
    while low and shared[low - 1] >= most:
        low -= 1
    while high + 1 < len(at) and shared[high] >= most:
        high += 1
    there = max(x for x in at[low : high + 1] if x > size)
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    k = int(np.searchsorted(begins, there, "right")) - 1
    return most, place, int(items[k - 1]), int(there - begins[k])


def shard_matches(probe: Probe, texts: list[str | None], longest: bool = True) -> tuple[np.ndarray, dict[int, tuple[list, np.ndarray, tuple]]]:
    """Words of each text; and for the texts with matches their spans (start, words), items, and, if asked for, longest match (words, start, item, start in it)."""
    get = probe.vocabulary.get
    # words become numbers text by text, so that only one text's words are in memory; a 0 ends each text
    parts = [np.array([*(get(w, 0) for w in words(t)), 0], np.int32) for t in texts]
    sizes = np.array([len(p) - 1 for p in parts], np.int64)
    if not probe.windows or not sizes.sum():
        return sizes, {}
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.concatenate(parts)
    del parts
    edges = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = last - first >= probe.shortest
    first, last = first[long], last[long]
    if not len(first):
        return sizes, {}
    # the runs, each followed by a 0; origin: where a position of theirs is in ids
    lengths = last - first + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    origin = np.arange(begins[-1]) + np.repeat(first - begins[:-1], lengths)
    text = ids[np.minimum(origin, len(ids) - 1)].copy()
    text[begins[1:] - 1] = 0
    array = suffix_array(text, probe.longest)
    array = array[text[array] > 0]
    found = {}
    for size, windows in probe.windows.items():
        place, key = _occurrences(text, array, windows.keys)
        found[size] = (origin[place], key)
    out: dict[int, tuple[list, np.ndarray, tuple]] = {}
    step = np.zeros(len(ids) + 1, np.int32)
    for size, (place, _) in found.items():
        np.add.at(step, place, 1)
        np.add.at(step, place + size, -1)
    covered = np.diff(np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    of = np.searchsorted(starts, begin, "right") - 1
    for doc in np.unique(of).tolist():
        low, high = starts[doc], starts[doc + 1]
        items = []
        for size, (place, key) in found.items():
            a, b = np.searchsorted(place, [low, high])
            if a == b:
                continue
            windows = probe.windows[size]
            items += [windows.items[windows.edges[w] : windows.edges[w + 1]] for w in np.unique(key[a:b])]
        first, last = np.searchsorted(of, [doc, doc + 1])
        spans = list(zip((begin[first:last] - low).tolist(), (end[first:last] - begin[first:last]).tolist(), strict=True))
        items = np.unique(np.concatenate(items))
        out[doc] = (spans, items, _longest(ids[low : high - 1], probe, items) if longest else (0, 0, 0, 0))
    return sizes, out


def shards(batch) -> Iterator:
    """Parts of an Arrow batch with a column text, of about SHARD_BYTES of it each."""
    import pyarrow.compute as pc

    ends = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SHARD_BYTES)))
        yield batch.slice(at, end - at)
        at = end


_LONGEST = "struct<n_words:long,doc_start:long,item_id:string,item_start:long>"
_FOUND = f"row long, key long, n_words long, spans array<struct<doc_start:long,n_words:long>>, items array<string>, longest {_LONGEST}"


def _searched(rows: DataFrame, items: list[tuple[str, str | None]], window: int, hits_only: bool, longest: bool) -> DataFrame:
    """What one block of items has in common with rows (row, key, text); for hits_only without rows that have nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(Probe(items, window))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = pa.int64()
        span = pa.list_(pa.struct([("doc_start", number), ("n_words", number)]))
        match = pa.struct([("n_words", number), ("doc_start", number), ("item_id", pa.string()), ("item_start", number)])
        probe = shared.value
        for batch in (part for whole in batches for part in shards(whole)):
            sizes, found = shard_matches(probe, batch.column("text").to_pylist(), longest)
            chosen = sorted(found) if hits_only else range(batch.num_rows)
            spans, items, best = [], [], []
            for k in chosen:
                own, names, (n, at, item, there) = found.get(k, ([], (), (0, 0, 0, 0)))
                spans.append([{"doc_start": a, "n_words": m} for a, m in own])
                items.append([probe.names[i] for i in names])
                best.append({"n_words": n, "doc_start": at, "item_id": probe.names[item], "item_start": there} if n else None)
            taken = batch.take(pa.array(chosen, pa.int64())) if hits_only else batch
            columns = [taken.column(0), taken.column(1), pa.array(sizes[list(chosen)], number)]
            arrays = [pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(best, match)]
            yield pa.RecordBatch.from_arrays(columns + arrays, ["row", "key", "n_words", "spans", "items", "longest"])

    return rows.mapInArrow(scan, _FOUND)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, longest: bool = True) -> DataFrame:
    """key, n_words, spans (doc_start, n_words: runs of words inside matches), items (distinct ids), longest (the longest match) per row.

    longest is n_words, doc_start, item_id, item_start, of equals the last; null without a match, or if not asked for. Items
    without words match nothing; an item of fewer words than the window is one window. Null and empty texts
    have no words. A null item id counts as the empty string, repeated ids as one item. Every row of docs
    gives one row, also where keys or texts repeat. An item travels whole to the tasks.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    in_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    load = lambda b: [tuple(r) for r in items.where(in_block == b).orderBy("item_id", "text").collect()]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if blocks > 1:
        rows = written(rows, "numbered")  # the numbers of all searches must agree
        # each search is written before the next begins, so that one block is in memory at a time
        found = reduce(DataFrame.unionByName, [written(_searched(rows, load(b), window, b > 0, longest), "found") for b in range(blocks)])
    else:
        found = _searched(rows, load(0), window, False, longest)
    if blocks > 1:
        found = found.groupBy("row").agg(
            F.first("key").alias("key"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"),
        )
    return found.select(F.col("key").alias(key), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"), "longest")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, longest: bool = True) -> DataFrame:
    """key, n_words, n_hit (words inside any match), items (sorted distinct ids), longest (words of the longest match; 0 if not asked for)."""
    spans = F.array_sort(F.transform("spans", lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    grown = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(s["end"], x["b"]).alias("end"),
    )
    return matches(docs, benchmark, key, text, window, longest).select(
        key,
        "n_words",
        F.aggregate(spans, none, grown)["n"].alias("n_hit"),
        "items",
        F.coalesce("longest.n_words", F.lit(0).cast("long")).alias("longest"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of the benchmark. Documents with a null key stay."""
    hit = contamination(docs, benchmark, key, text, window, longest=False).where("n_hit > 0").select(key).distinct()
    return docs.join(small(written(hit, "contaminated"), BROADCAST_IDS), key, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), longest=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS words
  FROM (SELECT *, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)
), places AS (
  SELECT row, s, size, array_to_string(w[s : s + size - 1], ' ') AS words
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM split, (SELECT DISTINCT size FROM windows))
), hits AS (SELECT row, s, p.size, item_id FROM places p JOIN windows USING (size, words)),
words AS (SELECT row, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT row, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY row),
names AS (
  SELECT row, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM split LEFT JOIN words USING (row) LEFT JOIN names USING (row)
"""
