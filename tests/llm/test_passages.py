"""Repeated passages and byte strings against brute force: graph dedup and suffix dedup, with hot lines and repeated ids."""

import collections
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tickframe.llm import debruijn, entry, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_passages(rows, size):
    split = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (key, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed, step, held, crowd, piece", [(1, 200_000, 300_000, 16, 1 << 20), (2, 90, 60, 2, 50), (3, 1_000, 300_000, 0, 1 << 20)])
def test_passages(spark, monkeypatch, seed, step, held, crowd, piece):
    """Copies, edited copies, periodic texts, a line in most documents, nulls, repeated ids with equal and other texts."""
    for name, value in {"STEP": step, "HELD": held, "CROWD": crowd, "PIECE": piece}.items():
        monkeypatch.setattr(debruijn, name, value)
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(2000)}"
    base, line = [word() for _ in range(400)], [word() for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n\x0b "), (3, "a " * 300), (4, "a b\t" * 200), (None, " ".join(base[:50])), (None, "a"), (5, "x " * 34), (5, "x " * 36), (5, "x " * 36)]
    for i in range(6, 120):
        a = pick.randrange(350)
        w = base[a : a + pick.randint(0, 120)]
        if pick.random() < 0.5 and w:
            w[pick.randrange(len(w))] = "é"
        w = [word() for _ in range(pick.randint(0, 60))] + w + [word() for _ in range(pick.randint(0, 40))] + line + [word() for _ in range(40)]
        rows.append((i // 2, pick.choice(" \n\t").join(w)))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, b int, path string").repartition(3)
    got = debruijn.remove_passages(df, keep_text=True).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute_passages(rows, 35)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r.spans) >= r.n_removed and all(s["end"] - s["start"] >= 35 for s in r.spans)
    assert debruijn.remove_passages(df.limit(0)).count() == 0


def test_passage_is_one_path(spark):
    """A passage that two documents share is one path of the graph; where a third leaves it, the path ends."""
    passage = [f"p{k}" for k in range(300)]
    own = lambda c: [f"{c}{k}" for k in range(50)]
    rows = [(1, own("a") + passage + own("b")), (2, own("c") + passage + own("d"))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in debruijn.remove_passages(df).collect()}
    assert {(s["start"], s["end"]) for v in spans.values() for s in v} == {(50, 350)} and len({s["path"] for v in spans.values() for s in v}) == 1
    branch = [(3, passage[:150] + own("e")), (4, passage[:150] + own("f"))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows + branch], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in debruijn.remove_passages(df).collect()}
    assert min(s["start"] for s in spans[1]) == 50 and max(s["end"] for s in spans[1]) == 350
    assert (spans[3][0]["start"], max(s["end"] for s in spans[3])) == (0, 150)


def test_unsound_coordinates_keep_their_words(spark, monkeypatch):
    """An edge whose words aren't those of the equal edge elsewhere is not taken away."""
    import numpy as np

    h = np.arange(1, 100, dtype=np.uint64)
    s, m = np.array([0, 10]), np.array([3, 0])
    prefix = debruijn.prefix_sums(h, debruijn._FACTORS[1])
    check = debruijn._span(prefix, s, s + m + 35, s, debruijn._FACTORS[1])
    assert debruijn._sound(h, s, m, check, 35).tolist() == [True, True]
    assert debruijn._sound(h, s, m, check ^ np.uint64(1), 35).tolist() == [False, False]


def brute_bytes(rows, size=100):
    """Rows of one key and text are one document; those of one key are in the order of their texts' prints."""
    seen, out = set(), {}
    for key, raw in sorted({(k, (t or "").encode()) for k, t in rows if k is not None}, key=lambda x: (x[0], suffix_dedup._print(x[1]))):
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if raw[k : k + size] in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(raw[k : k + size])
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key, raw] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return sorted(repr((k, *out[k, (t or "").encode()])) for k, t in rows if k is not None)


@pytest.mark.parametrize("crowd", [16, 1])
def test_one_id_with_several_texts(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    pick = random.Random(4)
    base = "".join(pick.choice("abcdefgh ") for _ in range(3000))
    cuts = [base[a : a + pick.randint(50, 900)] + "".join(pick.choice("xyz") for _ in range(pick.randint(0, 200))) for a in (pick.randrange(2500) for _ in range(60))]
    rows = [(k % 7, t) for k, t in enumerate(cuts)] + [(3, cuts[0]), (3, cuts[0]), (None, cuts[1]), (8, None), (8, "")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in got) == brute_bytes(rows)


def test_shared_footer_is_no_hot_group(spark):
    """A line of 90 bytes, too short to be removed, in every document: its positions are opened in the tasks that read them."""
    footer = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(90))
    docs = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(footer), F.sha2(F.concat(F.lit("x"), "id"), 512)).alias("text"))
    ranked = suffix_dedup._ranked(docs, 6, 64, 100, 32).where("b_id is not null")
    sizes = [r[0] for r in ranked.groupBy("r").agg(F.sum(F.octet_length("b_id"))).select("sum(octet_length(b_id))").collect()]
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
    found = suffix_dedup.remove_repeats(docs.withColumnRenamed("doc", "doc_id"))
    assert found.agg(F.sum("n_removed")).first()[0] == 0


def test_dedup_queries(spark, data):
    """The registered queries, all columns, on whole tables."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = entry.QUERIES["op5_suffix_dedup"](spark, data).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_bytes(rows)
    got = entry.QUERIES["op13_debruijn_dedup"](spark, data).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_passages(rows, 35)
