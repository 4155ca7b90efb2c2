"""The corpus operators against brute force, on small fixtures with nulls, empty and repeated rows, and against DuckDB."""

import collections
import gzip
import hashlib
import io
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tickframe.llm import chat, decontam, entry, graph, jaccard, mixing, pii, quality, simhash, suffix_dedup, token_counts, warc
from tickframe.llm.common import word_count

TABLES = "documents pages benchmark labels conversations".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "key": F.lit("x"), "source": F.lit("s")}) if extra else df


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_oracle(spark, data, con, name):
    got, want = entry.QUERIES[name](spark, data), con.sql(entry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(map(plain, got.select(*columns).collect())) == sorted(map(plain, want.select(", ".join(columns)).fetchall()))


def test_mix(spark):
    rows = [(k, "w " * (1 + k % 7), "abc"[k % 3] if k % 11 else None) for k in range(2000)] + [(5, None, "a"), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, word_count(F.col("text"))).cache()
    assert mixed.count() == len(rows) and mixed.agg(F.max("mix_copies")).first()[0] <= 2
    per = {r.source: r for r in mixed.groupBy("source").agg(F.sum("mix_size").alias("size"), F.max("mix_target").alias("target"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken")).collect()}
    total = sum(r["size"] for r in per.values())
    assert sum(r.target for r in per.values()) == pytest.approx(1.5 * total)
    for r in per.values():
        assert r.target <= 2 * r["size"] and abs(r.taken - r.target) <= 0.1 * r.target + 30
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mix(docs.limit(0), word_count(F.col("text"))).count() == 0


def test_warc(spark, tmp_path):
    rows = [(3, "http://x/ a", "same"), (1, None, "same"), (1, "u", "same"), (2, "u", ""), (9, "u", ""), (None, "u", "same"), (4, "é", "WARC/1.1\r\n\r\nx" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string")
    warc.write_warc(warc.with_revisits(pages, "page_id", "payload"), f"file://{tmp_path}/w", "page_id", "url", "payload")
    read = warc.read_warc(spark, f"file://{tmp_path}/w").cache()
    assert read.groupBy("record_type").count().collect() and read.count() == len(rows)
    got = sorted((r.record_type, r.record_id, r.refers_to or "") for r in read.collect())
    u = lambda k: f"<urn:page:{k}>"
    assert got == sorted([
        ("revisit", u(3), u(1)), ("response", u(1), ""), ("response", u(1), ""), ("response", u(2), ""), ("revisit", u(9), u(2)),
        ("revisit", u(""), u(1)), ("response", u(4), ""),
    ])
    bodies = {r.record_id: bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    assert bodies == {u(1): "same", u(2): "", u(4): "WARC/1.1\r\n\r\nx" * 3}
    heads = warc.read_warc(spark, f"file://{tmp_path}/w", "record_type string, record_id string")
    assert heads.where("record_type = 'revisit'").count() == 3
    assert read.where("record_type = 'response'").select(warc.base32_sha1(F.lit("abc").cast("binary"))).first()[0] == "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"


def shingles(t):
    w = WORD.findall(lower(t or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, z in sets[:k]:
            both = len(s & z)
            if both and 100 * both >= 75 * (len(s) + len(z) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets}


@pytest.mark.parametrize("seed, hot, heavy", [(1, 250_000, 1_000), (2, 20, 3), (3, 2, 40)])
def test_jaccard(spark, monkeypatch, seed, hot, heavy):
    for name, value in {"HOT_SETS": hot, "HOT_LOCAL": 2, "HEAVY": heavy, "FEW": 2 if seed < 3 else 0, "SALTS": 3}.items():
        monkeypatch.setattr(jaccard, name, value)
    pick = random.Random(seed)
    base = [pick.choice("abcdefgh") for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A \x0b b"), (4, " \n")]
    for i in range(5, 250):
        w = list(base) if i % 3 else [pick.choice("abcdefgh") for _ in range(pick.randint(1, 60))]
        for _ in range(pick.randint(0, 4)):
            w[pick.randrange(len(w))] = pick.choice("abcdefghijk")
        rows.append((i * 7, " ".join(w)))
    found = jaccard.near_duplicates(docs_of(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)


def test_jaccard_edges(spark):
    text = " ".join("abcdefghijkl")
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", None)]
    assert jaccard.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_components(spark):
    path = [(k, k + 1) for k in range(100, 140)] + [(500, 1), (500, 501), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 1: 1, 500: 1, 501: 1}


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    pick = random.Random(4)
    text = lambda n: " ".join(pick.choice(["a", "B", "ü", "1"]) for _ in range(pick.randint(0, n)))
    rows = [(i, text(60)) for i in range(150)] + [(900, None), (901, ""), (902, "!?")]
    items = [(str(i), text(14)) for i in range(25)] + [(None, "zz q"), ("x", None)]
    windows = {}
    for name, t in items:
        w = ITEM_WORD.findall(lower(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name or "")
    want = {}
    for i, t in rows:
        w, hit, names = ITEM_WORD.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        want[i] = (len(w), len(hit), sorted(names))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = docs_of(spark, rows)
    found = decontam.matches(docs, benchmark).collect()
    for r in found:  # the longest match is verbatim, and no item has one word more of it
        w = ITEM_WORD.findall(lower(dict(rows)[r.doc_id] or ""))
        if r.longest is None:
            assert not r.spans
            continue
        n, at, item, there = r.longest
        assert any(ITEM_WORD.findall(lower(t or ""))[there : there + n] == w[at : at + n] for name, t in items if (name or "") == item)
        longer = {tuple(x[k : k + n + 1]) for _, t in items for x in [ITEM_WORD.findall(lower(t or ""))] for k in range(len(x) - n)}
        assert n < 10 or not longer & {tuple(w[k : k + n + 1]) for k in range(len(w) - n)}
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.contamination(docs, benchmark).collect()}
    assert got == want
    assert {r.doc_id for r in decontam.decontaminate(docs, benchmark).collect()} == {i for i, x in want.items() if not x[1]}
    assert decontam.contamination(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def plain_fold(events):
    """The log event by event."""
    out = {}
    key = lambda e: tuple((x is not None, x) for x in (e[1], e[3], e[4], e[5]))
    for conv, _, turn, kind, role, text in sorted(events, key=lambda e: key(e)):
        turns = out.setdefault(conv, {})
        if kind == "regenerate" and turn is not None:
            for t in [t for t in turns if t is not None and t >= turn]:
                del turns[t]
        own = turns.setdefault(turn, [None, ""])
        own[0] = role if own[0] is None else own[0]
        own[1] = (text or "") if kind == "edit" else own[1] + (text or "")
    return {(c, t, *x) for c, turns in out.items() for t, x in turns.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_loop(spark, seed):
    """Random logs with nulls in every column, equal sequence numbers, repeated events, a long text and clashing columns."""
    pick = random.Random(seed)
    some = lambda *x: pick.choice([*x, *x, None])
    events = [
        (some(1, 2, 3), pick.randrange(60), some(0, 1, 2, 3), pick.choice(["delta"] * 4 + ["edit", "regenerate"]), some("user", "assistant"), some("a", "b", "ü"))
        for _ in range(300)
    ]
    events += events[:20] + [(9, 1, 0, "delta", "user", "x" * 1_000_000), (9, 2, 0, "delta", None, None)]
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    df = df.withColumns({c: F.lit(1) for c in ("cut", "edited", "parts", "place", "said")})
    assert {tuple(r) for r in chat.fold(df).collect()} == plain_fold(events)
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_streamed_logs_fold_back(spark):
    messages = [(c, t, pick, "x y ü" * (t % 4)) for c in (1, 2, 3) for t in range(1, 12) for pick in [("user", "assistant")[t % 2]]]
    log = chat.streamed(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    assert {tuple(r) for r in chat.fold(log).collect()} == set(messages)


def archive(blocks):
    """Uncompressed records, one for each block."""
    heads = (f"WARC/1.1\r\nWARC-Type: {'response' if k % 2 else 'metadata'}\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {len(b)}\r\n\r\n" for k, b in enumerate(blocks))
    return [h.encode() + b + b"\r\n\r\n" for h, b in zip(heads, blocks, strict=True)]


@pytest.mark.parametrize("kind", ["x.warc", "x.warc.gz", "members.warc.gz"])
def test_warc_files(spark, tmp_path, kind):
    """Uncompressed, compressed as a whole and record by record; a long payload; cut off inside a block, wanted or not."""
    blocks = [b"a" * 10, b"\xff\r\n" * 700_000, b"", b"b" * 200_000]
    made = archive(blocks)
    pack = {"x.warc": lambda r: b"".join(r), "x.warc.gz": lambda r: gzip.compress(b"".join(r)), "members.warc.gz": lambda r: b"".join(map(gzip.compress, r))}[kind]
    (tmp_path / kind).write_bytes(pack(made))
    read = lambda *a, **o: warc.read_warc(spark, f"file://{tmp_path}", *a, **o)
    assert [bytes(r.payload) for r in read().orderBy("record_id").collect()] == blocks
    assert read("record_id string").where("record_id is not null").count() == 4
    assert read("record_type string, payload binary").where("record_type = 'metadata'").count() == 2
    (tmp_path / kind).write_bytes(pack([*made[:3], made[3][:-100_000]]))
    for columns, filter_ in (("payload binary", "true"), ("record_id string", "true"), ("record_type string", "record_type = 'metadata'")):
        left = read(columns, mode="PERMISSIVE").where(filter_).count()
        assert left == (2 if "metadata" in filter_ else 3)
        with pytest.raises(Exception, match="cut off"):
            read(columns).where(filter_).collect()


def test_warc_passes_over_blocks():
    """Blocks that a filter or the schema doesn't want are not read."""
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    class Raw(io.BytesIO):
        taken = 0

        def readinto(self, into):
            got = super().readinto(into)
            self.taken += got
            return got

    data = b"".join(archive([b"x" * 1_000_000] * 6))
    for columns, kind, rows in (("record_id string", None, 6), ("record_type string, payload binary", "nothing", 0), ("payload binary", None, 6)):
        reader = warc.WarcReader(StructType.fromDDL(columns), {"path": "file:///none"})
        left = list(reader.pushFilters([*([EqualTo(("record_type",), kind)] if kind else []), GreaterThan(("content_length",), 3)]))
        assert len(left) == 1
        raw = Raw(data)
        assert len(list(reader.records(io.BufferedReader(raw, 1 << 12)))) == rows
        assert (raw.taken < 100_000) == ("payload" not in columns or kind is not None)


def test_decontamination_of_repetitive_texts(spark, monkeypatch):
    """Memory stays with the text where a document and an item repeat one word; rows with equal keys and texts stay apart over several blocks."""
    import tracemalloc

    probe = decontam.Probe([("x", "a " * 2000)])
    tracemalloc.start()
    sizes, found = decontam.shard_matches(probe, ["a " * 20_000])
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert sizes.tolist() == [20_000] and found[0][0] == [(0, 20_000)] and found[0][2] == (2000, 18_000, 0, 0)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    a, b = (" ".join(f"{x}{k}" for k in range(12)) for x in "ab")
    benchmark = spark.createDataFrame([("one", a), ("two", b), ("three", "c1 c2")], "item_id string, text string")
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a + " " + b), (2, a + " " + b), (None, None), (3, "c2 c1")], "doc_id long, text string")
    got = decontam.contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "items", "longest").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, [
        (1, 12, 12, ["one"], 12), (1, 12, 12, ["one"], 12), (1, 12, 12, ["two"], 12), (2, 24, 24, ["one", "two"], 12),
        (2, 24, 24, ["one", "two"], 12), (None, 0, 0, [], 0), (3, 2, 0, [], 0),
    ]))


def brute_repeats(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if raw[k : k + size] in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(raw[k : k + size])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("step", [400_000, 1_000])
def test_repeats(spark, monkeypatch, step):
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    pick = random.Random(3)
    rows = [(0, None), (1, ""), (2, "x" * 500), (3, "ab" * 300), (4, "x" * 99), (5, "é" * 200)]
    base = "".join(pick.choice("abcdefgh ") for _ in range(3000))
    for i in range(6, 150):
        a, k = pick.randrange(2500), pick.random()
        w = base[a : a + pick.randint(0, 400)]
        w = w[:100] + "z" + w[100:] if k < 0.5 else w
        rows.append((i * 3, (w + w if k < 0.2 else w) + " " + "".join(pick.choice("ab") for _ in range(pick.randint(0, 150)))))
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), keep_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == brute_repeats(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_edges(spark):
    rows = [(1, "q" * 150), (1, "q" * 150), (None, "q" * 150)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect())
    assert got == [("1", 149), ("1", 149), ("None", 0)]
    assert suffix_dedup.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_token_counts(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b<|startoftext|><|endoftext|>", "", None, "ΑΣ σς 数字123 ½ٱ́é J̌ İ it's 'S we'LL\x85\xa0a\x1cb\x00 12", "<|STARTOFTEXT|> x", "é" * 50 + "'s", "ǰ Ǆ ﬁ Å", "x" * 5000]
    texts = odd + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, texts[3])]
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for most in (100, token_counts.FREQUENT):
        assert sorted(tuple(r) for r in token_counts.count_tokens(docs_of(spark, rows), path, most=most).collect()) == want
    assert token_counts.count_tokens(docs_of(spark, rows).limit(0), path).count() == 0


def planted(pick, bad):
    words = ["the", "of", "and", "wind", "stone", "river", "light", "green", "walk", "open"]
    w = [pick.choice(words) + pick.choice(["", "s", "ing"]) for _ in range(80)]
    return " ".join(x.upper() + "!!" for x in w) if bad == 1 else " ".join([*w[:40], "scum", "idiot", *w[40:]]) if bad == 2 else " ".join(w)


def test_quality(spark):
    pick = random.Random(2)
    kinds = [pick.choice([0, 0, 0, 1, 2]) for _ in range(900)]
    rows = [(i, planted(pick, k), "en", f"s{i % 3}") for i, k in enumerate(kinds)] + [(5000, None, None, None), (5001, "", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 0 if k == 1 else 1, int(k == 2)) for i, k in enumerate(kinds[:400])] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    right = [scored[i] == (k == 0) for i, k in enumerate(kinds)]
    assert len(scored) == len(rows) and sum(right[400:]) / len(right[400:]) > 0.97  # held out
    assert quality.fit(docs, labels.limit(0)) is None and quality.score(docs, None).where("keep").count() == len(rows)
    again = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert again == {r.doc_id: r.score for r in quality.score(docs, model).collect()}



def test_quality_of_all(spark):
    """Documents teach the other view wherever the hash of their id puts them."""
    ids = [r.id for r in spark.range(2900).orderBy(F.xxhash64("id", F.lit("quality"))).collect()]
    late = set(ids[2600:])
    rows = [(i, f"{'calm river' if i % 2 else 'cheap pills'} {'zebra' if i in late and i % 2 else 'stone'}", "en", f"s{i % 2}") for i in ids]
    rows += [(i, "calm river" if i % 2 else "cheap pills", "en", f"s{i % 2}") for i in range(5000, 5100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5000, 5100)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model.text[quality._slot("w:zebra", quality.TEXT_SIZE)] > 0


def test_joined_words():
    slots = lambda w: set(quality.word_features(w))
    for joined in ("fine/toxicword", "a_b_Toxicword", "fine-toxicword,", "7toxicword"):
        assert quality._slot("w:toxicword", quality.TEXT_SIZE) in slots(joined) and quality._slot("p:toxi", quality.TEXT_SIZE) in slots(joined)


def test_immediate_repeats():
    slot = lambda text: quality.repeat_feature(text.split(), len(set(text.split())))
    assert slot("go go go go stop") == quality._slot("a:6", quality.TEXT_SIZE)
    assert slot("go stop go stop") == quality._slot("r:2:3", quality.TEXT_SIZE)
    assert slot("word") == quality._slot("r:0:1", quality.TEXT_SIZE)


def test_views_object():
    """A label is handed over where one view is sure and the other doesn't lean the other way."""
    import numpy as np

    view = lambda z: quality.View(np.arange(len(z) + 1), np.arange(len(z)), np.ones(len(z)), len(z))
    z = [np.array([9.0, 9.0, 9.0, -9.0, 0.0]), np.array([9.0, 1.0, -1.0, 1.0, -9.0])]
    limits = [quality._limits(np.ones(80 * quality.BINS + 1), 10**6, 10**6, (1.0, 0.0))] * 2
    said = quality._said([view(x) for x in z], ([np.append(x, 0.0) for x in z], limits))
    np.testing.assert_array_equal(said[:, 0], [1.0, 1.0, np.nan, np.nan, np.nan])
    np.testing.assert_array_equal(said[:, 1], [1.0, np.nan, np.nan, np.nan, 0.0])
    assert quality._limits(np.ones(80 * quality.BINS + 1), 10, 10, (0.0, 1.0))[:2] == (-1, 80 * quality.BINS + 1)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans():
    pick = random.Random(5)
    parts = ["@", ".", "1", "25", "a", "-", " ", "+", "(", ")", "4111111111111111", "a.b", "300", "x@y.z", "5", "é"]
    for _ in range(5000):
        t = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert pii.base_spans(t)[0] == brute_spans(t), t
    long = "9" * 200_000 + " " + "a" * 200_000 + "@" * 1000 + "1.1." * 20_000 + "+1" * 20_000
    assert isinstance(pii.base_spans(long)[0], list) and pii.islands(long)


def personal(pick):
    card = "4" + "".join(str(pick.randint(0, 9)) for _ in range(14))
    card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
    made = [f"jo.{pick.randint(10, 99)}@mail{pick.randint(0, 9)}.example.com", ".".join(str(pick.randint(1, 254)) for _ in range(4)), card, f"+1 ({pick.randint(200, 999)}) 555-{pick.randint(1000, 9999)}"]
    return pick.choice(made)


def test_field(spark):
    pick = random.Random(6)
    kinds = {"@": "email", "+": "phone"}

    def text():
        """A text and the spans that were put in it."""
        out, spans = "", []
        for _ in range(40):
            if pick.random() < 0.2:
                value = personal(pick)
                kind = kinds.get(next((c for c in "@+" if c in value), ""), "ip" if value.count(".") == 3 else "card")
                spans.append((len(out), len(out) + len(value), kind))
            else:
                value = pick.choice("the of wind 7 12 v2 3.0 stone".split())
            out += value + pick.choice(["", ",", "."]) + " "
        return out, spans

    train, test = [text()[0] for _ in range(400)], [text() for _ in range(40)]
    field = pii.fit([x for t in train for x in pii.examples(t)][:2000])
    found = real = both = 0
    for t, spans in test:  # held out, without the patterns
        a = {s for i in pii.islands(t) for s in field.spans(t, i)}
        found, real, both = found + len(a), real + len(spans), both + len(a & set(spans))
    assert both / found > 0.95 and both / real > 0.75, (found, real, both)
    joined = "call +1 (269) 555-3296 4524132264652876 now"
    rows = [(1, joined), (2, None), (3, ""), (3, ""), (4, "mail x@y.com.")]
    got = pii.find(docs_of(spark, rows), field).collect()
    assert len(got) == 5 and {r.doc_id: [s.kind for s in r.spans] for r in got}[1] == ["phone", "card"]
    texts = {r.doc_id: r.text for r in pii.mask(docs_of(spark, rows), field).collect()}
    assert texts == {1: "call [PHONE] [CARD] now", 2: None, 3: "", 4: "mail [EMAIL]."}


def brute_print(t):
    import xxhash

    w = WORD.findall((t or "").lower())
    if not w:
        return 0
    terms, votes = [w] if len(w) < 5 else [w[i : i + 5] for i in range(len(w) - 4)], [0] * 64
    for term in terms:
        h = 42
        for x in term:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(terms))


def test_simhash(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    prints = [brute_print(t) for _, t in sorted(rows, key=lambda r: -r[0])]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, data).collect()}
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    for k, (i, t) in enumerate(order):
        t, following, r = t or "", order[(k + 1) % len(order)][1] or "", got[i]
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[k]:016x}")
        assert (r.near_edited, r.near_next) == (like(prints[k], brute_print(edited)), like(prints[k], prints[(k + 1) % len(order)]))
        assert r.n_near == (sum((prints[k] ^ x).bit_count() <= 3 for x in prints) if i % 100 == 0 else None)


def test_within_radius(spark):
    pick = random.Random(8)
    base = [pick.getrandbits(64) for _ in range(20)]
    values = {b ^ sum(1 << pick.randrange(64) for _ in range(pick.randint(0, 5))) for b in base for _ in range(20)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in {x & (1 << 64) - 1 for x in values}] + [(None,)]
    df = spark.createDataFrame(signed, "fingerprint long")
    got = {(r.query, r.fingerprint) for r in simhash.within(df, df).collect()}
    known = [v for (v,) in signed if v is not None]
    assert got == {(a, b) for a in known for b in known if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_next_document(spark):
    rows = [(i, f"t{i}") for i in range(57)] + [(None, "last"), (30, "u30")]
    got = {(r.doc_id, r.text): r.next_text for r in simhash.with_next(docs_of(spark, rows)).where("not extra").collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    assert got == {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    assert simhash.with_next(docs_of(spark, rows).limit(0)).count() == 0


EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_fold(spark):
    log = [
        (1, 0, 0, "delta", "user", "Hel"), (1, 1, 0, "delta", None, "lo"), (1, 2, 1, "delta", "assistant", "Bad"), (1, 3, 2, "delta", "user", "gone"),
        (1, 4, 1, "regenerate", "assistant", "Go"), (1, 5, 1, "delta", None, "od"), (1, 6, 0, "edit", None, "Hi"), (1, 7, 0, "delta", None, "!"),
        (2, 0, 0, "delta", "user", None), (None, 0, 0, "delta", "user", "x"),
    ]
    got = chat.fold(spark.createDataFrame(log, EVENTS)).collect()
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in got} == {
        (1, 0): ("user", "Hi!"), (1, 1): ("assistant", "Good"), (2, 0): ("user", ""), (None, 0): ("user", "x"),
    }


def test_chat_round_trip(spark):
    pick = random.Random(9)
    parts = [*chat.CONTROLS, "\\", "[", "<", " ", "x", "é\n", "[\\INST]", " [/INST", "</s"]
    turns = [(c, t, pick.choice(["user", "assistant", "system", "to<|text|>ol", ""]), "".join(pick.choice(parts) for _ in range(pick.randint(0, 9)))) for c in range(60) for t in range(5)]
    done = chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = done.withColumn("turns", chat.parse(F.col("formatted"))).collect()
    want = collections.defaultdict(list)
    for c, _, role, text in turns:
        want[c].append((role, text))
    for r in rows:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [re.sub(r"(?s)\\(.)", r"\1", s.text) for s in r.segments if s.loss] == [t for role, t in want[r.conv_id] if role == "assistant"]


def test_pipeline(spark, data):
    import corpus_pipeline

    first = spark.read.parquet(f"{data}/documents.parquet")
    docs, seen = first, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        seen.append((name, out.count()))
        assert name == "mix" or out.columns == first.columns
        if name == "near_duplicates":
            again = jaccard.near_duplicates(out)
            assert again.where("doc_id <> component_id").count() == 0
            groups = jaccard.near_duplicates(docs).select("component_id").distinct().count()
            assert out.count() == groups
        if name == "decontaminate":
            left = decontam.contamination(out, spark.read.parquet(f"{data}/benchmark.parquet"))
            assert left.where("n_hit > 0").count() == 0
            clean = decontam.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet")).where("n_hit = 0").count()
            assert out.count() == clean
        if name == "pii":
            assert out.count() == docs.count()
            assert not [1 for r in out.collect() if pii.base_spans(r.text or "")[0]]
        docs = out
    assert corpus_pipeline.run(spark, data).count() == seen[-1][1]


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "one two three four five x@y.com", "en", "s"), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit("x") for c in "score keep base spans mix_size mix_target key doc n a b print component node token cut edited".split()})
    assert quality.score(docs, None).count() == pii.find(docs, pii.Field()).count() == mixing.mix(docs, word_count(F.col("text"))).count() == 2
    assert pii.mask(docs, pii.Field()).columns == docs.columns
    assert jaccard.near_duplicates(docs).count() == suffix_dedup.remove_repeats(docs).count() == simhash.with_next(docs).where("not extra").count() == 2
    benchmark = spark.createDataFrame([("a", "one two")], "item_id string, text string").withColumn("key", F.lit(1))
    assert decontam.decontaminate(docs, benchmark).count() == 1
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit("p").alias("payload"), F.lit(1).alias("refers_to"))
    assert warc.with_revisits(pages, "page_id", "payload").where("record_type = 'revisit'").count() == 1
    empty = warc.with_revisits(pages.limit(0), "page_id", "payload")
    warc.write_warc(empty, f"file://{tmp_path}/e", "page_id", "url", "payload")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_field_long_island():
    """A span across the 64th word of an island is proposed like any other."""
    field = pii.Field({"card|card=True": 20.0, "card|mixed=True": -40.0, "|bias": 1.0})
    text = "7x " * 62 + "4111 1111 1111 1111" + " 7x" * 20
    (island,) = pii.islands(text)
    assert field.spans(text, island) == [(186, 205, "card")]


def test_field_many_words():
    """A phone of six words before a card, both base matches of which run too far."""
    text = "+49 30 12 34 56 78 4111111111111111"
    (island,) = pii.islands(text)
    assert {(0, 6), (6, 7)} <= pii.Field().segments(text, island).keys()
    (_, words, gold), = pii.examples("+49 30 12 34 56 78")
    assert gold == [(0, len(words), "phone")]
