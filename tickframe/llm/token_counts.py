r"""Token counts of whole texts without token ids.

A document's tokens are the sum, over its pre-tokens, of the pieces into which the library splits each.
Pieces are counted once per distinct pre-token of the corpus, joined to the documents' pre-token
frequencies, and summed. The most frequent pre-tokens, a bounded number, travel to the tasks as a
dictionary; the rest join by shuffle, so that hot words never meet in one task.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import spread, table, written

#: Entries of the dictionary of frequent pre-tokens, each of at most FREQUENT_BYTES bytes: under 10 MB.
FREQUENT = 1 << 17
FREQUENT_BYTES = 64
LIMIT = 2048
#: Distinct pre-tokens that a task counts before it hands the counts on.
HELD = 200_000
#: Texts of only these characters are normalised and split here; all others by the library itself.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-įı-ſ]")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t\n\ra-z0-9ß-öø-ſ]+")


class PreTokenizer:
    """Pre-tokens and piece counts as the tokenizers library gives them for one file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        specials = [t["content"] for t in whole["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.quick = (whole["normalizer"], whole["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        whole |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": byte_level, "post_processor": None}
        self.pieces = Tokenizer.from_str(json.dumps(whole))

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, which the library takes out first."""
        parts = self.specials.split(text) if self.specials else [text]
        found = list(chain.from_iterable(map(self._of_part, parts))) if len(parts) > 1 else self._of_part(text)
        return found, len(parts) - 1

    def _of_part(self, part: str) -> list[str]:
        if self.quick and not _PLAIN.search(part):
            return _SPLIT.findall(part.lower())
        normal = self.library.normalizer.normalize_str(part)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.pieces.encode_batch(pretokens, add_special_tokens=False)]


# How the file that _SPLIT is for describes its normalizer and its split. Any other file takes the library's way.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@lru_cache(maxsize=4)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


def _batches(rows: Iterator, size: int) -> Iterator[list]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Distinct pre-tokens of all texts: pretoken, n (how often), pieces (counted once each)."""

    def partial(batches):
        import pyarrow as pa

        own, seen = pre_tokenizer(path), Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])
            seen.clear()
            return made

        for batch in batches:
            for value in batch.column(0):
                if (t := value.as_py()) is not None:
                    seen.update(own.split(t)[0])
                if len(seen) > HELD:
                    yield out()
        if seen:
            yield out()

    def counted(batches):
        import pyarrow as pa

        own = pre_tokenizer(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            pieces = [n for part in _batches(iter(words), 4096) for n in own.count(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int32())], ["pretoken", "n", "pieces"])

    sums = docs.select(text).mapInArrow(partial, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return sums.mapInArrow(counted, "pretoken string, n long, pieces int")


def frequent(vocab: DataFrame, most: int = FREQUENT) -> tuple[dict[str, int], int]:
    """Pieces of the pre-tokens seen at least `least` times, at most `most` of them, and `least` itself.

    least is a power of two, chosen from how many pre-tokens there are per power.
    """
    short = vocab.where(F.octet_length("pretoken") <= FREQUENT_BYTES)
    power = F.length(F.bin("n")).alias("power")
    sizes = {r["power"]: r["count"] for r in short.groupBy(power).count().collect()}
    total, least = 0, 1 << 62
    for p in sorted(sizes, reverse=True):
        if (total := total + sizes[p]) > most:
            break
        least = 1 << (p - 1)
    return {r["pretoken"]: r["pieces"] for r in short.where(F.col("n") >= least).select("pretoken", "pieces").collect()}, least


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = FREQUENT) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, as the tokenizers library counts without added tokens.

    Null and empty texts have 0 bytes and tokens. Special strings inside a text count as one token each,
    the library's default. Rows may repeat a key, with equal or other texts; each row gives one row. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    vocab = written(vocabulary(docs, path), "vocabulary")
    known, least = frequent(vocab, most)
    shared = spark.sparkContext.broadcast(known)
    rare = vocab.where((F.col("n") < least) | (F.octet_length("pretoken") > FREQUENT_BYTES)).select("pretoken", "pieces")

    def frequencies(batches):
        """A row per document, and one for each of its distinct pre-tokens that the dictionary lacks."""
        import pyarrow as pa
        import xxhash

        own, pieces = pre_tokenizer(path), shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = value.as_py() or ""
                raw = t.encode("utf-8", "surrogatepass")
                words, total = own.split(t)
                print_, others = xxhash.xxh64_intdigest(raw) - (1 << 63), []
                for w, n in Counter(words).items():
                    if (p := pieces.get(w)) is not None:
                        total += n * p
                    else:
                        others.append((w, n))
                # the document's own row joins nothing: no pre-token has digits after other characters
                for row in ((k, print_, f"\0{k}", 1, len(raw), total), *((k, print_, w, n, None, None) for w, n in others)):
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(out, kinds, strict=True)], names)

    import pyarrow as pa

    names = ["key", "print", "pretoken", "n", "n_bytes", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    rows = docs.mapInArrow(frequencies, "key long, print long, pretoken string, n long, n_bytes long, tokens long")
    joined = rows.join(rare, "pretoken", "left")
    tokens = F.coalesce("tokens", F.col("n") * F.col("pieces"))
    # equal rows are counted together and dealt out again
    return (
        joined.groupBy("key", "print")
        .agg(F.sum(tokens).alias("n_tokens"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("rows"))
        .withColumn("row", F.explode(F.expr("sequence(1, rows)")))
        .select(F.col("key").alias(key), "n_bytes", F.expr("n_tokens div rows").alias("n_tokens"))
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
