r"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans of four kinds. The random field works on islands, runs of neighbouring
words that hold a digit or an at sign. It scores whole candidate segments, single words and all runs of
words that could be one number, by features of the span (shape, digits, checks, the word before it), and a
dynamic programme over segment ends chooses boundaries and kinds together. It is trained on base spans of a bounded sample of documents;
islands where a pattern ran too far, such as a phone number that runs into a card number, are left out of
training and are what the field then resolves. Segments that it is sure of, and that pass their kind's
plain checks, are added; base spans stay.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import spread, table

KINDS = ("email", "ip", "card", "phone")
#: About this many documents, chosen by a hash of their id, and at most this many islands train the field.
TRAIN_DOCS = 20_000
TRAIN_ISLANDS = 3_000
#: Islands of more words or code points than these don't train the field, as a step's time grows with an island's size.
TRAIN_WORDS, TRAIN_CHARS = 12, 400
#: A span of several words is a card or a phone number, so it has no more digits than this and only these marks.
MOST_DIGITS = 19
_NUMBER = re.compile(r"[0-9 ().+-]*")
#: Posterior probability from which a segment is added.
SURE = 0.9
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As the contract's patterns; possessive, so that long runs of digits take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]\S*+")
_DIGITS = re.compile(r"[0-9]")
_RUNS = (re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+"), re.compile(r"[^\x00-\x7f]+"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plausible(kind: str, span: str) -> bool:
    if kind == "email":
        local, _, domain = span.partition("@")
        return bool(local) and _LOCAL.issuperset(local) and bool(_DOMAIN.fullmatch(domain))
    if kind == "ip":
        parts = span.split(".")
        # a part may have any number of zeros ahead
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts)
    if not _NUMBER.fullmatch(span):
        return False
    digits = "".join(_DIGITS.findall(span))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Base spans (start, end, kind) by start and kind; and matches of nine digits or more that failed their check."""
    found, failed = [], []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            size = m.end() - m.start()
            if kind == "card" and size < 12:
                continue
            if plausible(kind, m.group()):
                found.append((*m.span(), kind))
            elif size > 8 and len(_DIGITS.findall(m.group())) > 8:
                failed.append(m.span())
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found, failed


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an at sign, as the words' ends; one blank between neighbours."""
    out: list[list[tuple[int, int]]] = []
    for m in _HOT.finditer(text):
        start, floor = m.start(), out[-1][-1][1] if out else 0
        while start > floor and not text[start - 1].isspace():
            start -= 1
        if out and start == floor + 1 and text[floor] in " -":
            out[-1].append((start, m.end()))
        else:
            out.append([(start, m.end())])
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Ends of a segment without the marks around it."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def features(span: str, words: int, before: str) -> list[str]:
    """What is known of a whole candidate span; each is weighed with the span's kind."""
    digits = "".join(_DIGITS.findall(span))
    shape = span
    for pattern, letter in zip(_RUNS, "9ax", strict=True):
        shape = pattern.sub(letter, shape)
    counted = _RUNS[0].sub(lambda m: f"9{min(len(m.group()), 20)}", span)
    for pattern, letter in zip(_RUNS[1:], "ax", strict=True):
        counted = pattern.sub(letter, counted)
    out = ["bias", f"shape={shape[:24]}", f"counted={counted[:32]}", f"digits={min(len(digits), 20)}", f"words={words}"]
    out += [f"{k}={plausible(k, span)}" for k in KINDS]
    return [*out, f"before={before[-8:].lower()}", f"mixed={bool(digits) and any(c.isalpha() for c in span)}"]


class Field:
    """Weights by kind and feature, and by pairs of neighbouring kinds; kind '' is outside, one word at a time."""

    LABELS = ("", *KINDS)

    def __init__(self, weights: dict[str, float] | None = None):
        """weights: kind|feature and kind>kind with their weights; at the beginning the kind before is ^."""
        #: weights by feature, in the order of LABELS; and by pair of kinds
        self.table: dict[str, list[float]] = {}
        self.moves: dict[tuple[str, str], float] = {}
        for name, weight in (weights or {}).items():
            label, bar, feature = name.partition("|")
            if bar:
                self.table.setdefault(feature, [0.0] * len(self.LABELS))[self.LABELS.index(label)] = weight
            else:
                self.moves[tuple(name.split(">"))] = weight

    def segments(self, text: str, island: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[tuple[int, int], list[str]]]:
        """Candidate segments (first word, past the last): their ends in the text and features. A span of several words is at most as long as its marks let it be."""
        head = text[max(0, island[0][0] - 24) : island[0][0]].split()
        counts = [len(_DIGITS.findall(text, *w)) for w in island]
        plain = [bool(_NUMBER.fullmatch(text, *w)) for w in island]
        out = {}
        for i in range(len(island)):
            before = text[slice(*island[i - 1])] if i else head[-1] if head else ""
            digits = 0
            for j in range(i + 1, len(island) + 1):
                digits += counts[j - 1]
                # marks at the ends are cut off, so only words in between must be plain
                if j > i + 1 and (digits > MOST_DIGITS or j > i + 2 and not plain[j - 2]):
                    break
                a, b = trimmed(text, island[i][0], island[j - 1][1])
                if j == i + 1 or _NUMBER.fullmatch(text, a, b):
                    out[i, j] = ((a, b), features(text[a:b], j - i, before))
        return out

    def scores(self, candidates: dict) -> dict[tuple[int, int], dict[str, float]]:
        """Of each candidate the score as each kind; only single words can be outside."""
        get, none = self.table.get, [0.0] * len(self.LABELS)
        out = {}
        for (i, j), (_, known) in candidates.items():
            sums = map(sum, zip(none, *(w for f in known if (w := get(f))), strict=True))
            out[i, j] = {k: v for k, v in zip(self.LABELS, sums, strict=True) if k or j == i + 1}
        return out

    def pair(self, one: str, two: str) -> float:
        return self.moves.get((one, two), 0.0)

    def posteriors(self, scores: dict, n: int) -> tuple[dict[tuple[int, int, str], float], dict[tuple[str, str], float]]:
        """Probability of every labelled segment, and expected numbers of pairs of neighbours."""
        into: list[dict[str, float]] = [defaultdict(float) for _ in range(n + 1)]
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i, j in sorted(scores):
            ends[j].append((i, j))
        scale = [0.0] * (n + 1)
        into[0]["^"] = 1.0
        e = {s: {k: math.exp(min(40.0, max(-40.0, v))) for k, v in x.items()} for s, x in scores.items()}
        move = {(a, b): math.exp(self.pair(a, b)) for a in (*self.LABELS, "^") for b in self.LABELS}
        for j in range(1, n + 1):
            for i, _ in ends[j]:
                lift = math.exp(scale[i] - scale[j - 1])
                for k, v in e[i, j].items():
                    into[j][k] += lift * v * sum(x * move[p, k] for p, x in into[i].items())
            total = sum(into[j].values()) or 1.0
            for k in into[j]:
                into[j][k] /= total
            scale[j] = scale[j - 1] + math.log(total)
        out: list[dict[str, float]] = [defaultdict(float) for _ in range(n + 1)]
        out[n] = {k: 1.0 for k in self.LABELS}
        starts = defaultdict(list)
        for i, j in scores:
            starts[i].append(j)
        segments, pairs = {}, defaultdict(float)
        for i in range(n - 1, -1, -1):
            for j in starts[i]:
                lift = math.exp(scale[i] - scale[j])
                for k, v in e[i, j].items():
                    after = lift * v * out[j].get(k, 0.0)
                    mass = 0.0
                    for p in (*self.LABELS, "^") if i == 0 else self.LABELS:
                        step = after * move[p, k]
                        out[i][p] += step
                        if x := into[i].get(p, 0.0) * step:
                            pairs[p, k] += x
                            mass += x
                    segments[i, j, k] = mass
        return segments, pairs

    def best(self, scores: dict, n: int) -> list[tuple[int, int, str]]:
        """The best labelled segmentation."""
        into: list[dict[str, tuple]] = [{} for _ in range(n + 1)]
        into[0]["^"] = (0.0, None)
        for i, j in sorted(scores, key=lambda s: s[1]):
            for k, v in scores[i, j].items():
                for p, (x, _) in into[i].items():
                    total = x + self.pair(p, k) + v
                    if k not in into[j] or total > into[j][k][0]:
                        into[j][k] = (total, (i, p))
        j, k, out = n, max(into[n], key=lambda k: into[n][k][0]), []
        while j:
            i, p = into[j][k][1]
            out.append((i, j, k))
            j, k = i, p
        return out[::-1]

    def spans(self, text: str, island: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """Sure and plausible spans of the best segmentation of the whole island."""
        candidates = self.segments(text, island)
        scores = self.scores(candidates)
        chosen = [s for s in self.best(scores, len(island)) if s[2]]
        if not chosen:
            return []
        sure, _ = self.posteriors(scores, len(island))
        out = []
        for i, j, k in chosen:
            a, b = candidates[i, j][0]
            if sure[i, j, k] >= SURE and plausible(k, text[a:b]):
                out.append((a, b, k))
        return out


def examples(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[tuple[int, int, str]]]]:
    """Islands with their gold segments: context, words, labelled segments of the words."""
    found, failed = base_spans(text)
    failed = [f for f in failed if not any(s[0] <= f[0] and f[1] <= s[1] for s in found)]  # a phone's digits are no failed card
    for island in islands(text):
        a, b = island[0][0], island[-1][1]
        if len(island) > TRAIN_WORDS or b - a > TRAIN_CHARS or any(x < b and y > a for x, y in failed):
            continue
        own = sorted((s for s in found if s[0] < b and s[1] > a), key=lambda s: s[0] - s[1])
        gold, used = [], set()
        for s, e, kind in own:
            i = next((k for k, w in enumerate(island) if w[0] <= s < w[1]), None)
            j = next((k for k, w in enumerate(island) if w[0] < e <= w[1]), None)
            if i is None or j is None or used & set(range(i, j + 1)):
                continue
            if trimmed(text, island[i][0], island[j][1]) == (s, e):
                gold.append((i, j + 1, kind))
                used |= set(range(i, j + 1))
        gold += [(k, k + 1, "") for k in range(len(island)) if k not in used]
        cut = max(0, a - 24)
        yield text[cut:b], [(x - cut, y - cut) for x, y in island], sorted(gold)


def fit(training: list[tuple[str, list, list]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum likelihood by adaptive gradient steps, one island at a time in the given order."""
    field, at = Field(), {k: n for n, k in enumerate(Field.LABELS)}
    squares: dict[str, list[float]] = {}
    pair_squares: dict[tuple[str, str], float] = defaultdict(float)
    known = [(field.segments(text, island), len(island), gold) for text, island, gold in training]
    known = [x for x in known if all((i, j) in x[0] for i, j, _ in x[2])]

    def moved(weight: float, square: float, g: float) -> tuple[float, float]:
        g -= decay * weight
        square += g * g
        return (weight + rate * g / math.sqrt(square), square) if square > 1e-12 else (weight, square)

    for _ in range(rounds):
        for candidates, n, gold in known:
            segments, pairs = field.posteriors(field.scores(candidates), n)
            miss = {s: [0.0] * len(at) for s in candidates}
            for (i, j, k), p in segments.items():
                miss[i, j][at[k]] -= p
            turns = {s: -p for s, p in pairs.items()}
            last = "^"
            for i, j, k in gold:
                miss[i, j][at[k]] += 1.0
                turns[last, k] = turns.get((last, k), 0.0) + 1.0
                last = k
            step: dict[str, list[float]] = {}
            for s, by_kind in miss.items():
                if max(map(abs, by_kind)) > 1e-4:  # what is settled teaches nothing
                    for f in candidates[s][1]:
                        step[f] = [x + y for x, y in zip(step[f], by_kind, strict=True)] if f in step else by_kind
            for f, by_kind in step.items():
                w, q = field.table.setdefault(f, [0.0] * len(at)), squares.setdefault(f, [0.0] * len(at))
                for k, g in enumerate(by_kind):
                    w[k], q[k] = moved(w[k], q[k], g)
            for s, g in turns.items():
                field.moves[s], pair_squares[s] = moved(field.moves.get(s, 0.0), pair_squares[s], g)
    return field


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", most_docs: int = TRAIN_DOCS, most: int = TRAIN_ISLANDS) -> Field:
    """A field from islands of about most_docs documents, the same ones in every run, at most `most` islands.

    Islands of more than TRAIN_WORDS words or TRAIN_CHARS code points, and such in which a pattern's match failed
    its check, teach nothing. In texts to be searched islands of any size are read whole.
    """
    total = docs.count()
    part = F.pmod(F.xxhash64(F.col(key), F.lit("pii")), F.lit(1 << 20))
    chosen = docs.where(part < math.ceil((1 << 20) * min(1.0, most_docs / max(1, total)))).select(part.alias("part"), text)

    def scan(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        for batch in batches:
            rows = [(p, json.dumps(x)) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for x in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["part", "x"])

    import json

    rows = chosen.mapInArrow(scan, "part long, x string").distinct().orderBy("part", "x").limit(most).collect()
    return fit([json.loads(r["x"]) for r in rows])


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, field: Field, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with base and spans: arrays of kind, start, end (code points, end exclusive), by start and kind.

    spans holds the base spans and what the field adds where no base span is. Null and empty texts have none.
    Columns of docs stay, but for such as have the names of the new ones; rows may repeat.
    """
    docs = docs.drop(base, spans)
    shared = docs.sparkSession.sparkContext.broadcast((field.table, field.moves))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Field()
        own.table, own.moves = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            patterns, all_ = [], []
            for value in batch.column(text):
                t = value.as_py() or ""
                found, _ = base_spans(t)
                more = []
                for island in islands(t):
                    a, b = island[0][0], island[-1][1]
                    inside = [s for s in found if s[0] < b and s[1] > a]
                    for s in own.spans(t, island) if _room(t, island, inside) else []:
                        if not any(x < s[1] and y > s[0] for x, y, _ in inside):
                            more.append(s)
                as_rows = lambda x: [{"kind": k, "start": s, "end": e} for s, e, k in x]
                patterns.append(as_rows(found))
                all_.append(as_rows(sorted([*found, *more], key=lambda s: (s[0], KINDS.index(s[2])))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(patterns, kind), pa.array(all_, kind)], [*batch.schema.names, base, spans])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(scan, f"{fields}, `{base}` {_SPANS}, `{spans}` {_SPANS}")


def _room(text: str, island: list[tuple[int, int]], inside: list[tuple[int, int, str]]) -> bool:
    """Whether outside base spans an island has as many digits as a span could have, or an at sign."""
    left, last = [], island[0][0]
    for a, b, _ in sorted(inside):
        left.append(text[last : max(last, a)])
        last = max(last, b)
    rest = "".join([*left, text[last : island[-1][1]]])
    return "@" in rest or rest.count(".") > 2 or len(_DIGITS.findall(rest)) > 8


def mask(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; a span that overlaps an earlier one joins it."""
    columns = docs.columns
    found = find(docs, field, text, "pii_base", "pii_spans")
    step = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("last"))

    def grow(s, x):
        between = F.substring(F.col(text), (s["last"] + 1).cast("int"), F.greatest(x["start"] - s["last"], F.lit(0).cast("long")).cast("int"))
        fresh = F.concat(s["done"], between, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(
            F.when(x["start"] >= s["last"], fresh).otherwise(s["done"]).alias("done"), F.greatest(s["last"], x["end"]).alias("last")
        )

    done = F.aggregate("pii_spans", step, grow)
    rest = F.substring(F.col(text), (done["last"] + 1).cast("int"), F.length(text))
    return found.withColumn(text, F.when(F.size("pii_spans") > 0, F.concat(done["done"], rest)).otherwise(F.col(text))).select(*columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find(docs, train(docs))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said("base"), 256).alias("base_sha256"),
        said("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
