r"""Removal of repeated passages, by a de Bruijn graph of words that is compacted along its nonbranching paths.

An edge of the graph is a run of 35 words that stands in the corpus more than once. To ship every run would take
16 bytes and more for every word, so runs travel in bundles: of the 28 groups of 8 words in a run of 35, the one
with the smallest hash is picked, the leftmost if several, and runs that follow one another and pick the same
place are one bundle. Equal runs pick equal groups, so equal edges meet under their pick:

1. Bundles are dealt out by their pick. Bundles equal in all of their words repeat as a whole, a path of edges.
   Where a pick has several different bundles, those are opened.
2. For open bundles the words are fetched from their source and each run is dealt out by its own hash; runs that
   others equal are edges.
3. Edges that follow one another in some document are linked. A link is nonbranching if its first edge has no
   other follower and its second no other predecessor; joins find these, and alternating stars compact the
   paths that they form.
4. Edges go back to their documents by their coordinates. There each is verified on the words themselves, against
   the hash of an equal edge at another source, and edges of one path that follow on one another become spans.

What repeats within a task's own rows is settled there, so that no bundle is hot after the shuffle. A pick with
many different bundles in one task (a line that many documents share) isn't gathered: the task opens its bundles
and tells the pick's group so by one row. Rows between rounds are blocks of numbers, dealt by hash range or by bucket of documents.
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
from tickframe.llm.graph import components
from tickframe.llm.jaccard import mix
from tickframe.llm.suffix_dedup import _FACTORS, _range, _span, picks, prefix_sums

WINDOW, GRAM = 35, 8
#: Words that a task ranks at once; longer texts are ranked in overlapping pieces.
STEP = 200_000
#: Bundles, or opened runs, that a task holds before it hands them on.
HELD = 300_000
#: Different bundles of one pick, among HELD, from which on a task opens them itself.
CROWD = 16
#: Bytes of text per hash range, about 12,000 bundles a megabyte, and per bucket of documents.
RANGE_BYTES, BUCKET_BYTES = 32 << 20, 4 << 20
#: Distinct words whose hashes a task keeps, and bytes of text that are split at once.
MEMO, PIECE = 1 << 18, 1 << 20
_SPACE = bytes(0x20 if b in b"\t\n\v\f\r" else b for b in range(256))


@lru_cache(maxsize=1)
def _memo() -> dict:
    import xxhash

    class Memo(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= MEMO:
                self.clear()
            self[word] = got = xxhash.xxh64_intdigest(word)
            return got

    return Memo()


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    raw = raw.translate(_SPACE)
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):  # at a space, so that no word is cut
            end = raw.rfind(b" ", at, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def numbers(raw: bytes) -> np.ndarray:
    """A number for each word."""
    memo = _memo()
    parts = [np.array(list(map(memo.__getitem__, part)), np.uint64) for part in words(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _row(key: int | None, raw: bytes, buckets: int) -> tuple[int, int]:
    """Bucket and number of a row; rows of one key and text have the same, and are alike in all that follows."""
    import xxhash

    seed = (key or 0) & 0xFFFFFFFFFFFFFFFF
    return xxhash.xxh3_64_intdigest(raw, seed) % buckets, xxhash.xxh64_intdigest(raw, seed)


def _raw(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _pieces(batches: Iterator, window: int, buckets: int) -> Iterator[list[tuple]]:
    """Pieces of texts, together about STEP words: bucket and number of the row, where each starts, numbers of the words."""
    held, size = [], 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = _raw(value)
            h = numbers(raw)
            if len(h) < window:
                continue
            b, k = _row(key, raw, buckets)
            for base in range(0, len(h) - window + 1, STEP):
                part = h[base : base + STEP + window - 1]
                if held and size + len(part) > STEP:
                    yield held
                    held, size = [], 0
                held.append((b, k, base, part))
                size += len(part)
    if held:
        yield held


def _groups(new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by group, of which new marks the first: the sum of n over the group, and the row of another of the group."""
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(new)))
    total = np.repeat(np.add.reduceat(n.astype(np.int64), heads) if len(heads) else heads, sizes)
    leader = np.repeat(heads, sizes)
    # the first is held against the second, all others against the first
    other = np.where(new, np.minimum(leader + 1, np.repeat(heads + sizes - 1, sizes)), leader)
    return total, other


#: What is settled: documents' coordinates of edges (id, start, further runs), the edge's name and the other source's hash.
_SETTLED = {"id": "<u8", "start": "<i8", "more": "u1", "edge": "<u8", "check": "<u8"}
#: Bundles: rank of the pick, of all words, n: how many such there are (0: others are open, 2: these are settled already).
_BUNDLE = {"b": "<i4", "id": "<u8", "start": "<i8", "offset": "u1", "more": "u1", "rank": "<u8", "whole": "<u8", "check": "<u8", "n": "u1"}
_OPEN = {"id": "<u8", "start": "<i8", "offset": "u1", "more": "u1", "rank": "<u8", "n": "u1"}
_RUN = {"b": "<i4", "id": "<u8", "start": "<i8", "rank": "<u8", "check": "<u8", "n": "u1"}


def _edge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one ^ mix(two, 1))


_FROM_SCAN = schema("r", _SETTLED, _BUNDLE, _OPEN)
_FROM_PICKS = schema("b", _SETTLED, _OPEN)
_FROM_FETCH = schema("r", _SETTLED, _RUN)
_EDGES = schema("b", _SETTLED)


def _bundles(docs: DataFrame, bits: int, buckets: int, window: int, gram: int) -> DataFrame:
    """Step 1, before the shuffle: bundles by range of their pick; what is settled or opened here already, by bucket."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[dict] = []

        def out():
            x = {name: np.concatenate([h[name] for h in held]) for name in held[0]}
            held.clear()
            x = ordered(x, "rank", "whole")
            x["edge"] = _edge(x["rank"], x["whole"])
            new = unlike(x["rank"], x["whole"])
            total, other = _groups(new, np.ones(len(new)))
            own, x["check"], x["n"] = x["check"], x["check"][other], np.minimum(total, 2)
            again = total > 1
            settled = made(_FROM_SCAN, "a", x["b"][again], chosen(x, again, _SETTLED))
            x["check"] = own
            # picks with many different bundles
            top = np.flatnonzero(unlike(x["rank"], x["rank"]))
            crowd = np.repeat(np.add.reduceat(new.astype(np.int64), top) > CROWD, np.diff(np.append(top, len(new))))
            opened = made(_FROM_SCAN, "c", x["b"][new & crowd], chosen(x, new & crowd, _OPEN))
            told = np.zeros(len(new), bool)
            told[top] = crowd[top]
            x["n"] = np.where(told, 0, x["n"])
            x["whole"] = np.where(told, mix(x["rank"], 3), x["whole"])
            on = (new & ~crowd) | told
            dealt = made(_FROM_SCAN, "b", _range(x["rank"][on], bits), chosen(x, on, _BUNDLE))
            return pa.concat_tables([settled, opened, dealt]).to_batches()

        for parts in _pieces(batches, window, buckets):
            lengths = np.array([len(p[3]) for p in parts])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            data = np.concatenate([p[3] for p in parts])
            first, offset, more, rank, whole = picks(prefix_sums(data), starts, lengths, window, gram)
            of = np.searchsorted(starts, first, "right") - 1
            b, k, base = (np.array([p[i] for p in parts], t) for i, t in enumerate(("<i4", "<u8", "<i8")))
            check = _span(prefix_sums(data, _FACTORS[1]), first, first + more + window, first, _FACTORS[1])
            held.append(
                {"b": b[of], "id": k[of], "start": first - starts[of] + base[of], "offset": offset, "more": more, "rank": rank, "whole": whole, "check": check}
            )
            if sum(len(x["id"]) for x in held) > HELD:
                yield from out()
        if held:
            yield from out()

    return docs.mapInArrow(scan, _FROM_SCAN)


def _by_pick(group):
    """Step 1: bundles that others equal are settled, and where a pick has several bundles one of each is opened."""
    import pyarrow as pa

    early, opened, x = read(group, "a", _SETTLED), read(group, "c", _OPEN), read(group, "b", _BUNDLE)
    x = ordered(x, "rank", "whole")
    new, n = unlike(x["rank"], x["whole"]), x["n"]
    total, other = _groups(new, n)
    x["edge"], x["check"] = _edge(x["rank"], x["whole"]), x["check"][other]
    settled = (total > 1) & (n == 1)
    top = np.flatnonzero(unlike(x["rank"], x["rank"]))
    several = np.repeat(np.add.reduceat(new.astype(np.int64), top) > 1 if len(top) else top, np.diff(np.append(top, len(new)))).astype(bool)
    x["n"] = np.minimum(total, 2)
    open_ = new & several & (total > 0)
    parts = [made(_FROM_PICKS, "a", x["b"][settled], chosen(x, settled, _SETTLED)), made(_FROM_PICKS, "b", x["b"][open_], chosen(x, open_, _OPEN))]
    for kind, rows in (("a", early), ("b", opened)):
        if len(rows["id"]):  # what scan() dealt by bucket: all of this group
            parts.append(made(_FROM_PICKS, kind, np.full(len(rows["id"]), group.column(0)[0].as_py(), np.int32), rows))
    return pa.concat_tables(parts)


def _fetch(bits: int, window: int):
    """Step 2, before the shuffle: the runs of opened bundles, by range of their hash."""

    def fetch(marks, texts):
        import pyarrow as pa

        x = read(marks, "b", _OPEN)
        x = ordered(x, "id", "start")
        bucket = marks.column(0)[0].as_py() if len(marks) else 0
        held: list[dict] = []
        out: list = []

        def flush():
            y = {name: np.concatenate([h[name] for h in held]) for name in held[0]}
            held.clear()
            y = ordered(y, "rank", "check")
            new, n = unlike(y["rank"], y["check"]), y["n"]
            total, _ = _groups(new, n)
            y["edge"], y["more"], y["b"] = mix(y["rank"]), np.zeros(len(new), "u1"), np.full(len(new), bucket)
            again = (total > 1) & (n == 1)
            out.append(made(_FROM_FETCH, "a", y["b"][again], chosen(y, again, _SETTLED)))
            y["n"] = np.minimum(total, 2)
            out.append(made(_FROM_FETCH, "b", _range(y["rank"][new], bits), chosen(y, new, _RUN)))

        done = set()
        for k, packed in zip(_ids(texts), texts.column("packed"), strict=True):
            a, e = (int(np.searchsorted(x["id"], k, side)) for side in ("left", "right"))
            if a == e or k in done:
                continue
            done.add(k)
            h = numbers(_unpacked(packed))
            part = {name: column[a:e] for name, column in x.items()}
            for base in range(0, len(h), STEP):
                here = (part["start"] >= base) & (part["start"] < base + STEP)
                if not here.any():
                    continue
                s, o, m, r, n = (part[name][here] for name in ("start", "offset", "more", "rank", "n"))
                data = h[base : base + STEP + window + 255]
                counts = m.astype(np.int64) + 1
                of = np.repeat(np.arange(len(s)), counts)
                j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = s[of] - base + j
                # equal runs have equal picks at equal offsets
                pick = r[of] + mix((o[of].astype(np.int64) - j).astype(np.uint64))
                rank = mix(_span(prefix_sums(data), at, at + window, at) ^ mix(pick))
                check = _span(prefix_sums(data, _FACTORS[1]), at, at + window, at, _FACTORS[1])
                held.append({"id": np.full(len(at), k, np.uint64), "start": at + base, "rank": rank, "check": check, "n": n[of]})
                if sum(len(y["id"]) for y in held) > HELD:
                    flush()
        if held:
            flush()
        return pa.concat_tables(out) if out else made(_FROM_FETCH, "a", np.zeros(0, np.int32), {c: np.zeros(0, t) for c, t in _SETTLED.items()})

    return fetch


def _by_run(group):
    """Step 2: runs that others equal are edges."""
    import pyarrow as pa

    early, y = read(group, "a", _SETTLED), read(group, "b", _RUN)
    y = ordered(y, "rank", "check")
    total, _ = _groups(unlike(y["rank"], y["check"]), y["n"])
    again = (total > 1) & (y["n"] == 1)
    y["edge"], y["more"] = mix(y["rank"]), np.zeros(len(again), "u1")
    parts = [made(_EDGES, "a", y["b"][again], chosen(y, again, _SETTLED))]
    if len(early["id"]):
        parts.append(made(_EDGES, "a", np.full(len(early["id"]), group.column(0)[0].as_py(), np.int32), early))
    return pa.concat_tables(parts)


def _by_place(group) -> dict[str, np.ndarray]:
    """A bucket's edges by row and place, each once."""
    x = read(group, "a", _SETTLED)
    x = ordered(x, "id", "start")
    once = unlike(x["id"], x["start"])
    return {name: column[once] for name, column in x.items()}


def _links(group):
    """Step 3: pairs of different edges that follow one another in a document."""
    import pyarrow as pa

    x = _by_place(group)
    follows = (x["id"][1:] == x["id"][:-1]) & (x["start"][1:] == x["start"][:-1] + x["more"][:-1] + 1)
    pair = np.stack([x["edge"][:-1][follows], x["edge"][1:][follows]], 1).view(np.int64)
    pair = np.unique(pair, axis=0) if len(pair) else pair.reshape(0, 2)
    return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _numbered(group):
    """Each of a bucket's edges, by its place in _by_place()."""
    import pyarrow as pa

    x = _by_place(group)
    n = len(x["id"])
    bucket = group.column(0)[0].as_py() if n else 0
    return pa.table([pa.array(x["edge"].view(np.int64)), pa.array(np.full(n, bucket, np.int32)), pa.array(np.arange(n, dtype=np.int32))], ["edge", "b", "at"])


def paths(edges: DataFrame) -> DataFrame:
    """edge and path of the edges on nonbranching links; edges is a written table of _EDGES. All other edges are paths of their own."""
    links = written(edges.groupBy("b").applyInArrow(_links, "a long, b long").distinct(), "links")
    # one follower, one predecessor: of either, the smallest is the largest
    followed = links.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("most")).where("b = most").select("a", "b")
    preceded = links.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("most")).where("a = most").select("a", "b")
    return components(followed.join(preceded, ["a", "b"])).select(F.col("node").alias("edge"), F.col("component").alias("path"))


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts, compressed, with bucket and number of each row."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raws = [_raw(v) for v in batch.column(1)]
            rows = [_row(k, r, buckets) for k, r in zip(batch.column(0).to_pylist(), raws, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in rows], pa.int32()),
                    pa.array(np.array([k for _, k in rows], np.uint64).view(np.int64)),
                    batch.column(0),
                    pa.array([squeeze(r) for r in raws], pa.binary()),
                ],
                ["b", "id", "doc", "packed"],
            )

    return docs.mapInArrow(pack, "b int, id long, doc long, packed binary")


def _ids(texts) -> np.ndarray:
    return np.array(texts.column("id").to_pylist(), np.int64).view(np.uint64)


def _unpacked(packed) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed.as_py())


_SPANS = "array<struct<start:long,end:long,path:long>>"


def _finish(window: int, keep_text: bool):
    """Step 4: verified spans by document, and what is left of it."""

    def finish(marks, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        x = _by_place(marks)
        named = marks.filter(pc.is_valid(marks.column("at")))
        path = x["edge"].view(np.int64).copy()
        path[named.column("at").to_numpy()] = named.column("path").to_numpy()
        out: list[list] = [[] for _ in range(6)]
        for k, key, packed in zip(_ids(texts), texts.column("doc").to_pylist(), texts.column("packed"), strict=True):
            raw = _unpacked(packed)
            a, e = (int(np.searchsorted(x["id"], k, side)) for side in ("left", "right"))
            spans: list[tuple[int, int, int]] = []
            if a < e:
                s, m, check, p = (c[a:e] for c in (x["start"], x["more"].astype(np.int64), x["check"], path))
                sound = _sound(numbers(raw), s, m, check, window)
                s, m, p = s[sound], m[sound], p[sound]
                fresh = np.ones(len(s), bool)
                fresh[1:] = (s[1:] > s[:-1] + m[:-1] + 1) | (p[1:] != p[:-1])
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(s)) - 1
                spans = list(zip(s[heads].tolist(), (s[tails] + m[tails] + window).tolist(), p[heads].tolist(), strict=True)) if len(s) else []
            n, left, digest, kept = _kept(raw, spans, keep_text)
            named_spans = [{"start": i, "end": j, "path": p} for i, j, p in spans]
            for column, value in zip(out, (key, n, n - left, named_spans, digest, kept), strict=True):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("path", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc", "n_words", "n_removed", "spans", "kept_sha256", "kept"])

    return finish


def _sound(h: np.ndarray, s: np.ndarray, m: np.ndarray, check: np.ndarray, window: int) -> np.ndarray:
    """Which edges' words have the hash of the equal edge elsewhere."""
    ok = np.zeros(len(s), bool)
    for base in range(0, len(h), STEP):
        here = np.flatnonzero((s >= base) & (s < base + STEP))
        if len(here):
            at = s[here] - base
            prefix = prefix_sums(h[base : base + STEP + window + 255], _FACTORS[1])
            ok[here] = _span(prefix, at, at + m[here] + window, at, _FACTORS[1]) == check[here]
    return ok


def _kept(raw: bytes, spans: list[tuple[int, int, int]], keep_text: bool) -> tuple[int, int, str, str | None]:
    """Words, words left outside the spans, SHA-256 of these joined by spaces, and the joined words if asked for."""
    digest, kept = hashlib.sha256(), []
    n = left = k = 0
    for part in words(raw):
        at = 0
        rest: list[bytes] = []
        while k < len(spans) and spans[k][0] < n + len(part):
            rest += part[at : max(at, spans[k][0] - n)]
            at = max(at, min(len(part), spans[k][1] - n))
            if spans[k][1] > n + len(part):
                break
            k += 1
        rest += part[at:]
        if rest:
            said = (b" " if left else b"") + b" ".join(rest)
            digest.update(said)
            if keep_text:
                kept.append(said)
        left += len(rest)
        n += len(part)
    return n, left, digest.hexdigest(), b"".join(kept).decode("utf-8", "surrogatepass") if keep_text else None


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, spans (start, end, path; words), kept_sha256 and, if asked for, the kept words, per row.

    A word goes if a run of window words covers it that also stands elsewhere, in another row or in the same one,
    further along or overlapping; all places of such a run go, and runs are judged on the input. Spans of one path
    are pieces of one passage. Null and empty texts have no words, texts of fewer words than the window no runs.
    Each row is a document of its own, also where keys, or keys and texts, repeat or are null. An empty table gives
    an empty result; other columns are ignored, whatever their names. window is at most 255 words more than gram.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    # both follow the text; a setting only makes them finer
    bits = max(1, min(30, (max(total // RANGE_BYTES, n) - 1).bit_length()))
    buckets = min(1 << 30, max(total // BUCKET_BYTES, 2 * n))
    marks = written(_bundles(docs, bits, buckets, window, gram).groupBy("r").applyInArrow(_by_pick, _FROM_PICKS), "bundles")
    texts = _packed(docs, buckets)
    runs = marks.where("b_id is not null").groupBy("b").cogroup(texts.groupBy("b")).applyInArrow(_fetch(bits, window), _FROM_FETCH)
    runs = runs.groupBy("r").applyInArrow(_by_run, _EDGES)
    settled = marks.where("a_id is not null").select("b", *(f"a_{name}" for name in _SETTLED))
    edges = written(settled.unionByName(runs), "edges")
    places = edges.groupBy("b").applyInArrow(_numbered, "edge long, b int, at int")
    named = places.join(paths(edges), "edge").select("b", "at", "path")
    kind = f"doc long, n_words long, n_removed long, spans {_SPANS}, kept_sha256 string, kept string"
    both = edges.unionByName(named, allowMissingColumns=True)
    out = both.groupBy("b").cogroup(texts.groupBy("b")).applyInArrow(_finish(window, keep_text), kind)
    return out.withColumnRenamed("doc", key) if keep_text else out.withColumnRenamed("doc", key).drop("kept")


def op13_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return remove_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT row, s, array_to_string(w[s : s + 34], ' ') AS words FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS s FROM split WHERE len(w) >= 35)
), again AS (SELECT words FROM runs GROUP BY words HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, unnest(range(s, s + 35)) AS at FROM runs JOIN again USING (words)),
kept AS (
  SELECT s.row, count(*) AS n, string_agg(word, ' ' ORDER BY s.at) AS words
  FROM (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM split) s ANTI JOIN gone g ON g.row = s.row AND g.at = s.at
  GROUP BY s.row
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (row)
"""
