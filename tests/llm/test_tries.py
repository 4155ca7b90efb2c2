"""Importance resampling and the conversation trie against brute force, with edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tickframe.llm import importance, prefix_trie
from tickframe.llm.common import written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_sample(docs, target, longest, buckets, percent, least, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(of(f) for _, t in docs for f in features(t, longest)[1])
    t = collections.Counter(of(f) for x in target for f in features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, x in docs:
        n, found = features(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(f)) for f in found)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    return sorted(map(repr, [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in able[len(drawn) :] + [r for r in rows if r[1] < least]]))


@pytest.mark.parametrize("longest, nodes, piece", [(1, 1 << 20, 1 << 20), (3, 40, 64), (2, 1 << 20, 16)])
def test_resample(spark, monkeypatch, longest, nodes, piece):
    """Nulls, blank and long texts, ties, repeated rows and clashing columns; tries and pieces that are handed on early."""
    monkeypatch.setattr(importance, "NODES", nodes)
    monkeypatch.setattr(importance, "PIECE", piece)
    pick = random.Random(longest)
    vocabulary = ["a", "B", "Ä", "数字", "x1", "l" * 100, "é"]
    docs = [(0, None), (1, ""), (2, " \n-"), (None, "a B x1"), (None, "a B x1"), (3, "a " * 3000)]
    docs += [(k % 90 + 4, pick.choice([" ", "-"]).join(pick.choices(vocabulary, k=pick.randint(1, 40)))) for k in range(120)]
    docs += docs[-3:]
    target = ["x1 数字 x1", None, "a", "é é"]
    rows = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, score int, key int, rank int").repartition(3)
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(rows, aimed, longest=longest, buckets=50, percent=30, least=3, seed=7)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == brute_sample(docs, target, longest, 50, 30, 3, 7)


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.resample(docs.limit(0), docs).count() == 0
    r = importance.resample(docs, docs.limit(0), percent=100).first()
    assert r["rank"] == 1 and r["weight"] == 30 * math.floor(1000 * math.log((10_000 + 30) / (31 * 10_000)))


def brute_trie(rows, rebuilt):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    cut = lambda c: zlib.crc32(str(c).encode()) % 9
    whole = {c: own.get(c - int(math.fmod(c, 5)), [])[: cut(c)] + x[cut(c) :] for c, x in own.items()} if rebuilt else own
    members = collections.defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node], sum(1 for n in below if not kids[n]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie(spark, monkeypatch, rebuilt):
    """Nulls in all columns, negative ids, equal turns, repeated rows, copies, a long conversation, clashing columns."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    pick = random.Random(5)
    rows = [(None, 1, "user", "lost"), (-7, None, None, None), (-7, 0, "user", ""), (12, 1, "b", "x"), (12, 1, "a", "y"), (12, 1, "a", "y"), (9, 0, "1:", "z"), (8, 0, "1", ":z")]
    rows += [(c, k, "user", f"é{pick.randint(0, 1)}") for c in range(20, 80) for k in range(pick.randint(1, 12)) if c % 10]
    rows += [(c, k, "user", "same") for c in range(100, 130) for k in range(4)] + [(200, k, "u", "deep") for k in range(150)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, conv int").repartition(4)
    got = prefix_trie.prefix_trie(df, rebuilt=rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_trie(rows, rebuilt)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_rows_are_linear(spark):
    """Copies send nothing up, and a deep conversation sends a row for each of its beginnings."""
    df = spark.range(40).select(F.lit(0).alias("turn"), F.col("id").alias("conv_id"), F.lit("u").alias("role"), F.lit("x").alias("text"))
    df = df.unionByName(spark.range(300).select(F.col("id").alias("turn"), F.lit(99).cast("long").alias("conv_id"), F.lit("u").alias("role"), F.lit("y").alias("text")))
    own = prefix_trie.turns(df)
    begun = written(prefix_trie.beginnings(prefix_trie.borrowed(own)), "begun")
    assert begun.count() <= 2 * 40 + 301
