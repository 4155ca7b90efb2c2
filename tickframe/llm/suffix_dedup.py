r"""Removal of repeated byte strings, by prefix doubling over synchronised positions.

Sorting a rank for every byte costs 16 bytes of shuffle per byte and round. Here only positions are ranked
that content itself picks: of the 69 strings of 32 bytes inside a string of 100, the one with the smallest
hash, the leftmost if several. Equal strings of 100 bytes pick equal positions, so that every string of 100
bytes is judged at one picked position, with those equal to it. Ranks double in rounds:

1. Spark deals positions out by the rank of their 32 bytes; unique ones leave.
2. Those that stay are ranked by the pair of that rank and the rank of all bytes that their strings of 100
   cover. Whatever shares this pair with an earlier position repeats it throughout and is settled; positions
   whose 32 bytes have one pair are settled too.
3. For what is open, the first position of each pair, the bytes are fetched and every string of 100 gets a
   rank of its own, past the threshold; all but the first of a rank repeat.

In each round what repeats within a task's own block is settled there, so that no pair is hot after the shuffle.
A rank that has many pairs within one block (a short line that many documents share) isn't gathered either: the
task opens these positions itself and sends one row by which the rank's range knows that others are open.

Rows between rounds are blocks of numbers, dealt by hash range or by bucket of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.blocks import chosen, made, ordered, read, schema, unlike
from tickframe.llm.common import partitions, spread, table, written
from tickframe.llm.jaccard import mix

THRESHOLD = 100
GRAM = 32
#: Bytes that a task ranks at once; longer texts are ranked in overlapping pieces.
STEP = 400_000
#: Positions that a task holds before it hands them on.
HELD = 400_000
#: Pairs of one rank, among HELD positions, from which on a task opens them itself.
CROWD = 16
_BITS = np.uint64(20)
_MASK = np.uint64((1 << 20) - 1)
#: Bytes of text per hash range, about 30,000 positions a megabyte, and per bucket of documents; they bound what a group holds.
RANGE_BYTES, BUCKET_BYTES = 16 << 20, 4 << 20
#: Odd factors of two hashes of bytes.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _powers(n: int, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of an odd factor and of its inverse, mod 2^64."""
    fill = lambda f: np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, f, np.uint64)), dtype=np.uint64)
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(factor)), fill(factor), fill(pow(factor, -1, 1 << 64))


def prefix_sums(numbers: np.ndarray, factor: int = _FACTORS[0]) -> np.ndarray:
    """From these sums _span() takes the hash of any span of numbers, 2 * STEP at most."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers * _powers(2 * STEP, factor)[1][: len(numbers)], dtype=np.uint64)])


def _prefix(data: np.ndarray, factor: int = _FACTORS[0]) -> np.ndarray:
    return prefix_sums(_powers(2 * STEP, factor)[0][data], factor)


def _span(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice, factor: int = _FACTORS[0]) -> np.ndarray:
    """Hashes of the bytes from start to end, by content alone."""
    return mix((prefix[end] - prefix[start]) * _powers(2 * STEP, factor)[2][at])


def _range(rank: np.ndarray, bits: int) -> np.ndarray:
    """The range of a rank. Picked ranks are the least of many, so they are mixed again to fill all ranges alike."""
    return (mix(rank, 7) >> np.uint64(64 - bits)).astype(np.int64)


def positions(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, threshold: int, gram: int):
    """picks() of bytes."""
    return picks(_prefix(data), starts, lengths, threshold, gram)


def picks(prefix: np.ndarray, starts: np.ndarray, lengths: np.ndarray, threshold: int, gram: int):
    """Picked positions of concatenated pieces: first string's start, offset of the pick, further strings, rank, covered rank."""
    n = len(prefix) - 1
    rank = _span(prefix, slice(0, n - gram + 1), slice(gram, n + 1), slice(0, n - gram + 1))
    least = (rank & ~_MASK) | np.arange(len(rank), dtype=np.uint64)
    width, span = threshold - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = n - threshold + 1
    least = np.minimum(least[:count], least[width - span : width - span + count])
    pick = (least & _MASK).astype(np.int64)
    for a, length in zip(starts, lengths, strict=True):
        pick[a + length - threshold + 1 : a + length] = -1
    change = np.flatnonzero(pick[1:] != pick[:-1]) + 1
    first, last = np.concatenate([[0], change]), np.append(change, count) - 1
    real = pick[first] >= 0
    first, last = first[real], last[real]
    at = pick[first]
    shape = ((at - first) * 256 + (last - first)).astype(np.uint64)
    covered = mix(_span(prefix, first, last + threshold, first) + mix(shape))
    return first, at - first, last - first, rank[at], covered


def _pieces(batches: Iterator, threshold: int) -> Iterator[tuple[list[int], list[int], list[int], list[np.ndarray]]]:
    """Pieces of texts, together about STEP bytes: ids, where each starts in its text, prints of the texts, bytes."""
    ids, bases, prints, held, size = [], [], [], [], 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
            if key is None or len(raw) < threshold:
                continue
            data, own = np.frombuffer(raw, np.uint8), _print(raw)
            for base in range(0, len(raw) - threshold + 1, STEP):
                part = data[base : base + STEP + threshold - 1]
                if held and size + len(part) > STEP:
                    yield ids, bases, prints, held
                    ids, bases, prints, held, size = [], [], [], [], 0
                ids.append(key)
                bases.append(base)
                prints.append(own)
                held.append(part)
                size += len(part)
    if held:
        yield ids, bases, prints, held


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each id; packed() gives the same."""
    ids = ids.astype(np.int64)
    return (ids ^ (ids.view(np.uint64) >> np.uint64(15)).view(np.int64)) % buckets


def _print(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(raw)


#: A place: document, print of its text, offset. The order of places is that of the documents, of the prints, of the offsets.
_PLACE = ("id", "print", "start")
#: What is settled: strings that start from start to last repeat.
_SETTLED = {"id": "<i8", "print": "<u4", "start": "<i8", "last": "<i8"}
#: Picked positions; offset of the pick in its first string, further strings, rank of the pick and of all bytes covered.
_PICK = {"id": "<i8", "print": "<u4", "start": "<i8", "offset": "u1", "more": "u1", "rank": "<u8", "covered": "<u8"}
#: Positions whose strings get ranks of their own.
_OPEN = {"id": "<i8", "print": "<u4", "start": "<i8", "offset": "u1", "more": "u1", "rank": "<u8"}
_STRING = {"id": "<i8", "print": "<u4", "start": "<i8", "rank": "<u8", "second": "<u4"}
#: Round 1 by range: settled and opened by the task itself, picked positions; crowd: ranks that others have opened.
_FROM_SCAN = schema("r", _SETTLED, _PICK, _OPEN) + ", crowd binary"
_MARKS = schema("b", _SETTLED, _OPEN)
_LATE = schema("r", _SETTLED, _STRING)
_DONE = schema("b", _SETTLED)


def _later(new: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
    """Of rows sorted by what is equal, then by place: those that come later than the first of their group, which new marks."""
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.logical_or.reduce([x[c] != x[c][leader] for c in _PLACE])


def _merged(*parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Intervals of starts, those that follow on one another in a document as one."""
    x = ordered({c: np.concatenate([p[c] for p in parts]) for c in _SETTLED}, *_PLACE)
    new = unlike(x["id"], x["print"])
    new[1:] |= x["start"][1:] > x["last"][:-1] + 1
    heads = np.flatnonzero(new)
    if not len(heads):
        return x
    return {c: x[c][heads] for c in _PLACE} | {"last": np.maximum.reduceat(x["last"], heads)}


def _grouped(new: np.ndarray, of: np.ndarray) -> np.ndarray:
    """By row the number of `new` in its group; of marks the first of each group."""
    tops = np.flatnonzero(of)
    return np.repeat(np.add.reduceat(new.astype(np.int64), tops), np.diff(np.append(tops, len(new)))) if len(tops) else np.zeros(0, np.int64)


def _as_crowd(table, ranks: np.ndarray | None = None, bits: int = 1):
    """A table of another kind with the column crowd, or the rows of the given crowd."""
    import pyarrow as pa

    if ranks is None:
        return table.append_column("crowd", pa.nulls(len(table), pa.binary()))
    return made("r int, k_crowd binary", "k", _range(ranks, bits), {"crowd": ranks}).rename_columns(["r", "crowd"])


def _ranked(docs: DataFrame, bits: int, buckets: int, threshold: int, gram: int) -> DataFrame:
    """Round 1, before the shuffle: picked positions by range of their rank; what is settled or opened here, by bucket."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[dict] = []
        plain = schema("r", _SETTLED, _PICK, _OPEN)

        def out():
            x = ordered({c: np.concatenate([h[c] for h in held]) for c in held[0]}, "rank", "covered", *_PLACE)
            held.clear()
            x["last"] = x["start"] + x["more"]
            new, tops = unlike(x["rank"], x["covered"]), unlike(x["rank"])
            # what repeats within this block is settled here, and so are hot pairs
            again = _later(new, x)
            done = _merged(chosen(x, again, _SETTLED))
            # a rank with many pairs would be hot: its positions are opened here, and its range is told
            crowd = _grouped(new, tops) > CROWD
            on, opened = ~again & ~crowd, ~again & crowd
            picked = ordered(chosen(x, on, _PICK), *_PLACE)  # so that places compress
            tables = [
                _as_crowd(made(plain, "a", _bucket(done["id"], buckets), done)),
                _as_crowd(made(plain, "c", _bucket(x["id"][opened], buckets), chosen(x, opened, _OPEN))),
                _as_crowd(made(plain, "b", _range(picked["rank"], bits), picked)),
                _as_crowd(None, x["rank"][tops & crowd], bits),
            ]
            return pa.concat_tables(tables, promote_options="default").to_batches()

        for ids, bases, prints, parts in _pieces(batches, threshold):
            lengths = np.array([len(p) for p in parts])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            first, offset, more, rank, covered = positions(np.concatenate(parts), starts, lengths, threshold, gram)
            of = np.searchsorted(starts, first, "right") - 1
            held.append(
                {"id": np.array(ids, np.int64)[of], "print": np.array(prints, np.uint32)[of], "start": first - starts[of] + np.array(bases)[of]}
                | {"offset": offset, "more": more, "rank": rank, "covered": covered}
            )
            if sum(len(x["id"]) for x in held) > HELD:
                yield from out()
        if held:
            yield from out()

    return docs.mapInArrow(scan, _FROM_SCAN)


def _pair_round(buckets: int):
    """Rounds 1 and 2: what is settled as repeated, and what is open, by bucket of documents."""

    def rerank(group):
        import pyarrow as pa

        crowd = np.frombuffer(b"".join(c for c in group.column("crowd").to_pylist() if c), "<u8")
        x = ordered(read(group, "b", _PICK), "rank", "covered", *_PLACE)
        x["last"] = x["start"] + x["more"]
        new = unlike(x["rank"], x["covered"])
        again = _later(new, x)
        several = (_grouped(new, unlike(x["rank"])) > 1) | np.isin(x["rank"], crowd)
        done, open_ = _merged(chosen(x, again, _SETTLED)), chosen(x, new & several, _OPEN)
        tables = [made(_MARKS, kind, _bucket(y["id"], buckets), y) for kind, y in (("a", done), ("b", open_))]
        return pa.concat_tables([*tables, *_passed(group, _MARKS, a=(_SETTLED, "a"), c=(_OPEN, "b"))])

    return rerank


def _passed(group, to: str, **kinds: tuple[dict, str]) -> list:
    """What was dealt by bucket already, in a range's group because a bucket of the same number is."""
    out = []
    for kind, (types, other) in kinds.items():
        x = read(group, kind, types)
        if n := len(x["id"]):
            x = _merged(x) if types is _SETTLED else x
            out.append(made(to, other, np.full(len(x["id"]) if n else 0, group.column(0)[0].as_py()), x))
    return out


def _fetch(bits: int, threshold: int):
    """Round 3, before the shuffle: a rank for every string of an open position, by range of that rank."""

    def fetch(marks, texts):
        import pyarrow as pa

        x = ordered(read(marks, "b", _OPEN), *_PLACE)
        n = len(x["id"])
        last = x["start"] + x["more"]
        cut: list[bytes] = [b""] * n
        for key, raw in _texts(texts):
            a, b = np.searchsorted(x["id"], [key, key + 1]) if key is not None else (0, 0)
            if a == b:
                continue
            own = _print(raw)
            a, b = a + np.searchsorted(x["print"][a:b], [own, own + 1])
            for k in range(a, b):
                cut[k] = raw[x["start"][k] : last[k] + threshold]
        ranks, seconds, rows, steps = [], [], [], []
        each = STEP // (3 * threshold)
        for k in range(0, n, each):
            part = slice(k, min(n, k + each))
            sizes = last[part] - x["start"][part] + threshold
            data = np.frombuffer(b"".join(cut[part]), np.uint8)
            counts = sizes - threshold + 1
            of = np.repeat(np.arange(len(sizes)), counts)
            j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at = (np.cumsum(sizes) - sizes)[of] + j
            # equal strings have equal picks at equal offsets
            pick = x["rank"][part][of] + mix((x["offset"][part].astype(np.int64)[of] - j).astype(np.uint64))
            ranks.append(mix(_span(_prefix(data), at, at + threshold, at) ^ mix(pick)))
            seconds.append((_span(_prefix(data, _FACTORS[1]), at, at + threshold, at, _FACTORS[1]) >> np.uint64(32)).astype(np.uint32))
            rows.append((k + of).astype(np.int32))
            steps.append(j.astype(np.uint8))
        row, step = np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate(steps or [np.zeros(0, np.uint8)])
        rank, second = (np.concatenate(v or [np.zeros(0, t)]) for v, t in ((ranks, np.uint64), (seconds, np.uint32)))
        order = np.lexsort((second, rank))  # rows are in order of place, and so stay equal ranks
        row, step = row[order], step[order]
        y = {"id": x["id"][row], "print": x["print"][row], "start": x["start"][row] + step, "rank": rank[order], "second": second[order]}
        y["last"] = y["start"]
        again = _later(unlike(y["rank"], y["second"]), y)
        done = _merged(chosen(y, again, _SETTLED))
        left = ordered(chosen(y, ~again, _STRING), *_PLACE)  # so that places compress
        at = marks.column(0)[0].as_py() if len(marks) else 0
        return pa.concat_tables([made(_LATE, "a", np.full(len(done["id"]), at), done), made(_LATE, "b", _range(left["rank"], bits), left)])

    return fetch


def _past_threshold(buckets: int):
    """Round 3: of strings of one rank all but the first repeat."""

    def rerank(group):
        import pyarrow as pa

        y = ordered(read(group, "b", _STRING), "rank", "second", *_PLACE)
        y["last"] = y["start"]
        done = _merged(chosen(y, _later(unlike(y["rank"], y["second"]), y), _SETTLED))
        return pa.concat_tables([made(_DONE, "a", _bucket(done["id"], buckets), done), *_passed(group, _DONE, a=(_SETTLED, "a"))])

    return rerank


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    heads = np.flatnonzero(new)
    return start[heads], end[np.append(heads[1:], len(start)) - 1]


def _finish(threshold: int, keep_text: bool):
    def finish(marks, texts):
        import pyarrow as pa

        x = ordered(read(marks, "a", _SETTLED), *_PLACE)
        end = x["last"] + threshold
        seen: dict[tuple[int, int], bytes] = {}
        out: list[list] = [[] for _ in range(6)]
        for key, raw in _texts(texts):
            a, b = np.searchsorted(x["id"], [key, key + 1]) if key is not None else (0, 0)
            kept, first, last = raw, [], []
            if b > a:
                own = _print(raw)
                if seen.setdefault((key, own), digest := hashlib.sha256(raw).digest()) != digest:
                    raise ValueError(f"different texts of document {key} have one print")
                a, b = a + np.searchsorted(x["print"][a:b], [own, own + 1])
            if b > a:
                p, q = runs(x["start"][a:b], end[a:b])
                first, last = p.tolist(), q.tolist()
                kept = b"".join(raw[p:q] for p, q in zip([0, *last], [*first, len(raw)], strict=True))
            spans = [{"start": p, "end": q} for p, q in zip(first, last, strict=True)]
            row = (key, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
            for column, v in zip(out, row, strict=True):
                column.append(v)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return finish


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts, compressed, with the bucket that _bucket gives; null keys are in bucket 0."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            b = _bucket(np.array([k or 0 for k in batch.column(0).to_pylist()], np.int64), buckets)
            texts = [squeeze((v.as_py() or "").encode("utf-8", "surrogatepass")) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), batch.column(0), pa.array(texts, pa.binary())], ["b", "doc", "packed"])

    return docs.mapInArrow(pack, "b int, doc long, packed binary")


def _texts(texts) -> Iterator[tuple[int | None, bytes]]:
    """Keys and texts of packed rows, one at a time."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    for key, value in zip(texts.column("doc").to_pylist(), texts.column("packed"), strict=True):
        yield key, open_(value.as_py())


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, keep_text: bool = False
) -> DataFrame:
    """key, n_bytes, n_removed, spans (removed runs of bytes), kept_sha256 and, if asked for, the kept bytes, per row.

    A byte goes if a string of threshold bytes covers it that also starts earlier: in a document of smaller
    key, or further ahead in the same one. Strings overlap freely and are judged on the input. Null texts are
    empty. A row whose key is null keeps its bytes and repeats nothing. Rows that repeat a key with the same text
    are one document and get the same result. Rows that repeat it with another text are documents of their own,
    in the order of a 32-bit print of the text; should two of their prints be equal, the job ends with an error.
    threshold is at most 255 bytes more than gram.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # both follow the text; a setting only makes them finer
    bits = max(1, min(30, (max(total // RANGE_BYTES, n) - 1).bit_length()))
    buckets = min(1 << 30, max(total // BUCKET_BYTES, 2 * n))
    ranked = _ranked(docs, bits, buckets, threshold, gram)
    marks = written(ranked.groupBy("r").applyInArrow(_pair_round(buckets), _MARKS), "marks")
    # the same shuffle of texts serves round 3 and the end
    texts = _packed(docs, buckets)
    open_ = marks.where("b_id is not null").groupBy("b").cogroup(texts.groupBy("b"))
    late = open_.applyInArrow(_fetch(bits, threshold), _LATE).groupBy("r").applyInArrow(_past_threshold(buckets), _DONE)
    settled = marks.where("a_id is not null").select("b", *(f"a_{name}" for name in _SETTLED)).unionByName(late)
    schema_ = "doc long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    out = settled.groupBy("b").cogroup(texts.groupBy("b")).applyInArrow(_finish(threshold, keep_text), schema_)
    return out.withColumnRenamed("doc", key) if keep_text else out.withColumnRenamed("doc", key).drop("kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
