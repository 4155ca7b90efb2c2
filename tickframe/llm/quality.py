r"""A quality classifier by co-training.

Two logistic classifiers see different views of a document. The text view has its distinct words: each
run of letters and its first four letters, the word's shape (case, marks behind it, whether it has letters),
and how often words repeat, at once or anywhere; a slot weighs as much as the labels' shares with and without it differ. The metadata view has source and language and the page's layout: size, lines, shares of
capitals, of other marks and of blanks. Both learn from labelled documents; then, over rounds, both score
all unlabelled documents, and each gives those that it is surest of, by quantiles of its scores over the
whole corpus and calibrated on held-out labels, with its labels to the other; not those that the other
holds for the opposite. At the end both are calibrated on held-out labels and combined,
and all documents are scored.

A document counts as good if its quality is 1 and it isn't toxic. The labelled documents of fitting are a
bounded sample, chosen by a hash of the id; everything else, and the scores, cover all documents. Their
features are written once, in blocks; tasks sum gradients over blocks, in whole multiples of 2^-24, so
that sums don't depend on how blocks are dealt.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import partitions, spread, table, written

#: Labelled documents that are fetched for fitting, at most.
LABELLED = 5_000
ROUNDS = 3
#: Gradient steps after each round.
STEPS = 10
#: Share of the unlabelled documents that each view hands to the other in a round.
HANDED = 0.1
#: Calibrated probability from which a view is sure of a label.
SURE = 0.99
#: Documents whose features make a block.
BLOCK = 2_000
#: Logits are counted in bins of 1 / BINS, up to 40 either way, and gradients in 1 / UNIT.
BINS, UNIT = 100, 1 << 24
#: Hash buckets of the two views' weights.
TEXT_SIZE, META_SIZE = 1 << 19, 1 << 12
THRESHOLD = 0.5
MEMO = 1 << 18
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = bytes(range(0x41, 0x5B))
_PLAIN = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x20, 0x0A])


def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


#: Checksums of the names' beginnings, carried on by the rest.
_RUN, _PREFIX, _SHAPE = (zlib.crc32(x) for x in (b"w:", b"p:", b"s:"))


@lru_cache(maxsize=1 << 16)
def _shape(capitals: bool, tail: str) -> int:
    return zlib.crc32(f"{'A' if capitals else 'a'}:{tail}".encode("utf-8", "surrogatepass"), _SHAPE) % TEXT_SIZE


def word_features(word: str) -> list[int]:
    """Slots of a word: its shape; and for each of its distinct runs of letters the run and its first four letters."""
    core = word[:-1] if word[-1] in ",.;:!?" else word
    if core.isalpha():  # one run, as of most words
        core, shape = core.lower(), _shape(len(core) > 1 and core.isupper(), word[len(core) :])
        name = core.encode("utf-8", "surrogatepass")
        prefix = name[:4] if core.isascii() else core[:4].encode("utf-8", "surrogatepass")
        return [shape, zlib.crc32(name, _RUN) % TEXT_SIZE, zlib.crc32(prefix, _PREFIX) % TEXT_SIZE]
    slot = lambda start, name: zlib.crc32(name.encode("utf-8", "surrogatepass"), start) % TEXT_SIZE
    found = _LETTERS.findall(word)
    if not found:
        return [slot(_SHAPE, f"-:{word[:4]}"), slot(_RUN, word[:40]), slot(_PREFIX, "")]
    first = found[0]
    at = word.index(first) + len(first)
    out = [_shape(len(first) > 1 and first.isupper(), word[at : at + 4])]
    for core in dict.fromkeys([x.lower() for x in found]):
        out += (slot(_RUN, core), slot(_PREFIX, core[:4]))
    return out


def repeat_feature(words: list[str], distinct: int) -> int:
    """Slot of how often a word is the one before it, by tenths; if that is rare, of how often the text's words repeat, by half powers of two, and the power of its size."""
    n = len(words)
    again = 10 * sum(map(eq, words, islice(words, 1, None))) // n
    return _slot(f"a:{again}" if again else f"r:{int(2 * np.log2(n / distinct))}:{min(n.bit_length(), 6)}", TEXT_SIZE)


def meta_features(source: str | None, lang: str | None, text: str) -> list[int]:
    """Slots of the metadata view."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    share = lambda k: min(20, int(40 * k / n))
    lines = raw.count(b"\n") + 1
    upper, odd, blank = n - len(raw.translate(None, _UPPER)), len(raw.translate(None, _PLAIN)), raw.count(b" ")
    facts = (
        f"source={source}", f"lang={lang}", f"size={n.bit_length()}", f"lines={lines.bit_length()}", f"line={(n // lines).bit_length()}",
        f"upper={share(upper)}", f"odd={share(odd)}", f"blank={share(blank)}", "bias",
    )
    return [_slot(f, META_SIZE) for f in facts]


class View:
    """Rows of slots with weights, as one long array each, and logistic weights for them."""

    def __init__(self, starts: np.ndarray, slots: np.ndarray, values: np.ndarray, size: int):
        self.starts, self.slots, self.values, self.size = starts, slots, values, size

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.places(chosen)
        return np.repeat(np.arange(len(chosen), dtype=np.int32), self.starts[chosen + 1] - self.starts[chosen]), self.slots[at], self.values[at]

    def places(self, chosen: np.ndarray) -> np.ndarray:
        """Where the slots of some rows are."""
        counts = self.starts[chosen + 1] - self.starts[chosen]
        return np.repeat(self.starts[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def gradient(self, chosen: np.ndarray, labels: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """The gradient of the log likelihood as a function of the weights; the last weight is the bias."""
        row, slot, value = self.take(chosen)

        def at(weights: np.ndarray) -> np.ndarray:
            z = np.bincount(row, weights[slot] * value, len(chosen)) + weights[-1]
            miss = labels - _sigmoid(z)
            return np.append(np.bincount(slot, miss[row] * value, self.size), miss.sum())

        return at

    def logits(self, chosen: np.ndarray, weights: np.ndarray) -> np.ndarray:
        row, slot, value = self.take(chosen)
        return np.bincount(row, weights[slot] * value, len(chosen)) + weights[-1]

    def all_logits(self, weights: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return np.bincount(rows, weights[self.slots] * self.values, len(self.starts) - 1) + weights[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray, soft: bool = True) -> tuple[float, float]:
    """Slope and offset that turn logits into calibrated ones, on labels softened as Platt does or as they are."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2)) if soft else y
    a, b, scale = 1.0, 0.0, max(1.0, float(np.abs(z).max(initial=0)))
    x = z / scale
    for _ in range(400):
        miss = target - _sigmoid(a * x + b)
        w = _sigmoid(a * x + b) * (1 - _sigmoid(a * x + b)) + 1e-6
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum(miss * x), np.sum(miss)]))
        a, b = a + 0.5 * step[0], b + 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a / scale, b


class Classifier:
    """Weights of both views, their calibrations, and how they combine."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, calibration: list[tuple[float, float]], shares: tuple[float, float, float]):
        self.text, self.meta, self.calibration, self.shares = text.astype(np.float32), meta.astype(np.float32), calibration, shares

    def combine(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and of both together, from the views' logits."""
        (a, b), (c, d) = self.calibration
        t, m = a * text + b, c * meta + d
        x, y, z = self.shares
        return _sigmoid(t), _sigmoid(m), _sigmoid(x * t + y * m + z)


def _telling(view: View, chosen: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How far each slot's share of the good rows is from that of the bad ones: the smoothed log ratio's size, and 1 for the bias.

    A tenth is added, so that slots which no labelled row has can be learnt from the other view.
    """
    row, slot, _ = view.take(chosen)
    good, bad = np.bincount(slot, labels[row], view.size), np.bincount(slot, 1 - labels[row], view.size)
    ratio = np.log((good + 1) / (labels.sum() + 2)) - np.log((bad + 1) / (len(labels) - labels.sum() + 2))
    return np.append(0.1 + np.where(good + bad, np.abs(ratio), 0.0), 1.0)


def _step(weights: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
    """One adaptive gradient step, in place."""
    squares += gradient**2
    weights += gradient / np.sqrt(squares)


def cotrain(
    text: View, meta: View, labels: np.ndarray, blocks: DataFrame, rounds: int = ROUNDS, handed: float = HANDED, decay: float = 1e-5
) -> Classifier:
    """labels are of the rows of text and meta; the unlabelled documents are in blocks. Every fifth labelled row is held out for calibration.

    The documents that a view was handed weigh as much as its labelled ones together, at most.
    """
    n = len(labels)
    held = np.arange(n)[np.arange(n) % 5 == 4]
    own = np.setdiff1d(np.arange(n), held)
    views = (text, meta)
    local = [v.gradient(own, labels[own]) for v in views]
    scales = [_telling(text, own, labels[own]), np.ones(meta.size + 1)]
    weights = [np.zeros(v.size + 1) for v in views]
    squares = [np.full(v.size + 1, 1e-8) for v in views]
    for k in (0, 1):
        for _ in range(150):
            _step(weights[k], squares[k], scales[k] * local[k](scales[k] * weights[k]) - decay * len(own) * weights[k])
    held = held if len(held) else own
    good = labels[own].mean() if len(own) else 0.5
    rules, given, most = [], [], 0
    short = lambda: [(s * w).astype(np.float32) for s, w in zip(scales, weights, strict=True)]
    for r in range(rounds):
        rule = short()
        counts = _histograms(blocks, rules, rule)
        rest = int(counts[0].sum())
        most = most if r else int(handed * rest)
        if rest < 2 * most or not most:
            break
        calibration = [_platt(v.logits(held, w), labels[held], soft=False) for v, w in zip(views, rule, strict=True)]
        limits = [_limits(c, max(1, round(most * (1 - good))), max(1, round(most * good)), k) for c, k in zip(counts, calibration, strict=True)]
        given.append(_choose(blocks, rules, (rule, limits)))
        rules.append((rule, limits))
        taught = reduce(DataFrame.unionByName, given)
        total = taught.agg(F.sum("n_text"), F.sum("n_meta")).first()
        if not any(total):
            continue
        share = [min(1.0, len(own) / t) if t else 0.0 for t in total]
        for _ in range(STEPS):
            far = _gradients(taught, short())
            for k in (0, 1):
                size = len(own) + share[k] * (total[k] or 0)
                near = local[k](scales[k] * weights[k])
                _step(weights[k], squares[k], scales[k] * (near + share[k] * far[k]) - decay * size * weights[k])
    weights = [s * w for s, w in zip(scales, weights, strict=True)]
    logits = [v.logits(held, w) for v, w in zip(views, weights, strict=True)]
    calibration = [_platt(z, labels[held]) for z in logits]
    calibrated = [a * z + b for z, (a, b) in zip(logits, calibration, strict=True)]
    return Classifier(*weights, calibration, _shares(*calibrated, labels[held]))


def _limits(counts: np.ndarray, low: int, high: int, calibration: tuple[float, float]) -> tuple[float, float, float]:
    """Bins up to and from which documents are handed over: those of the given numbers, equals included, if the calibrated view is sure of them.

    And the bin of even odds; none if the view's logits say nothing.
    """
    slope, offset = calibration
    if slope <= 0:
        return -1, len(counts), np.nan
    sure = np.log(SURE / (1 - SURE))
    bad, even, good = (np.floor(np.clip((40 + (x - offset) / slope) * BINS, -1, len(counts))) for x in (-sure, 0, sure))
    up, down = np.cumsum(counts), np.cumsum(counts[::-1])
    return min(np.searchsorted(up, low), bad - 1), max(len(counts) - 1 - np.searchsorted(down, high), good + 1), even


def _bins(z: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(z, -40, 40) + 40) * BINS).astype(np.int64)


def _said(views: list[View], rule: tuple[list[np.ndarray], list[tuple[float, float, float]]]) -> np.ndarray:
    """What the views say of each row: a column each of 0, 1 or, where the view isn't sure or the other holds the opposite, NaN."""
    weights, limits = rule
    at = [_bins(v.all_logits(w)) for v, w in zip(views, weights, strict=True)]
    out = []
    for own, other, (low, high, _), (*_, even) in zip(at, at[::-1], limits, limits[::-1], strict=True):
        out.append(np.where((own <= low) & ~(other > even), 0.0, np.where((own >= high) & ~(other <= even), 1.0, np.nan)))
    return np.stack(out, 1).astype(np.float32)


def _open(block: dict, views: list[View], rules: list) -> np.ndarray:
    """Which rows have no label and were not handed over by earlier rules."""
    free = np.isnan(block["target"])
    for rule in rules:
        free &= np.isnan(_said(views, rule)).all(1)
    return free


def _histograms(blocks: DataFrame, rules: list, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For both views, how many open rows have their logit in which bin."""
    shared = blocks.sparkSession.sparkContext.broadcast((rules, weights))
    size = 80 * BINS + 1

    def scan(batches: Iterator) -> Iterator:
        rules, weights = shared.value
        out = np.zeros((2, size), np.int64)
        for block in _read(batches):
            views = _views(block)
            free = _open(block, views, rules)
            for k in (0, 1):
                out[k] += np.bincount(_bins(views[k].all_logits(weights[k])[free]), minlength=size)
        yield _binary(out)

    found = _summed(_few(blocks).mapInArrow(scan, "x binary"), 2 * size)
    shared.destroy()
    return list(found.reshape(2, size))


def _choose(blocks: DataFrame, rules: list, rule: tuple) -> DataFrame:
    """Blocks of the open rows that one of the views hands over, with what the other view is taught."""
    shared = blocks.sparkSession.sparkContext.broadcast((rules, rule))

    def scan(batches: Iterator) -> Iterator:
        rules, rule = shared.value
        for block in _read(batches):
            views = _views(block)
            said = _said(views, rule)
            chosen = np.flatnonzero(_open(block, views, rules) & ~np.isnan(said).all(1))
            if len(chosen):
                yield _batch(_take(block, views[0], chosen), said[chosen][:, ::-1])

    out = written(blocks.mapInArrow(scan, f"{_BLOCK}, taught binary, n_text long, n_meta long"), "quality")
    shared.destroy()
    return out


def _gradients(taught: DataFrame, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Gradients of both views, summed over all rows that they were taught."""
    shared = taught.sparkSession.sparkContext.broadcast(weights)

    def scan(batches: Iterator) -> Iterator:
        weights = shared.value
        out = np.zeros(sum(map(len, weights)), np.int64)
        for block in _read(batches):
            labels, parts = block["taught"].reshape(-1, 2), []
            for k, view in enumerate(_views(block)):
                rows = np.flatnonzero(~np.isnan(labels[:, k]))
                parts.append(view.gradient(rows, labels[rows, k].astype(np.float64))(weights[k]))
            out += np.rint(np.concatenate(parts) * UNIT).astype(np.int64)
        yield _binary(out)

    found = _summed(_few(taught).mapInArrow(scan, "x binary"), sum(map(len, weights))) / UNIT
    shared.destroy()
    return np.split(found, [len(weights[0])])


def _few(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores: each makes one large sum."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def _shares(t: np.ndarray, m: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic weights of the two calibrated views and an offset, none of the views negative."""
    x, y_, z = 1.0, 0.5, 0.0
    for _ in range(300):
        miss = y - _sigmoid(x * t + y_ * m + z)
        x = max(0.0, x + 0.05 * float(np.mean(miss * np.clip(t, -8, 8))))
        y_ = max(0.0, y_ + 0.05 * float(np.mean(miss * np.clip(m, -8, 8))))
        z += 0.05 * float(np.mean(miss))
    return x, y_, z


def _features(docs: DataFrame) -> DataFrame:
    """part and the packed features of both views, of each document."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo = Memo(lambda word: array("i", word_features(word)).tobytes())
        for batch in batches:
            out = []
            for text, source, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang")), strict=True):
                slots, counts, scale = text_features(text or "", memo)
                facts = np.array(meta_features(source, lang, text or ""), np.int16)
                pieces = (np.array([scale]), facts, _planes(np.diff(slots, prepend=np.int32(0))), _planes(counts))
                out.append(zlib.compress(b"".join(x if isinstance(x, bytes) else x.tobytes() for x in pieces), 1))
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.binary())], ["part", "raw"])

    return docs.mapInArrow(scan, "part long, raw binary")


#: Slots of the metadata view per document.
FACTS = 9
#: Arrays of a block, and the types of what they hold. Slots and counts of all rows follow each other.
_TYPES = {"part": np.int64, "target": np.float32, "size": np.int32, "scale": np.float64, "facts": np.int16, "slots": np.int32, "counts": np.int32}
_BLOCK = ", ".join(f"{n} binary" for n in _TYPES)


def _planes(a: np.ndarray) -> bytes:
    """An array of int32, all lowest bytes first: this compresses well."""
    return np.ascontiguousarray(a.astype(np.int32, copy=False).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def _unpacked(raw: bytes) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    at = 8 + 2 * FACTS
    middle = at + (len(raw) - at) // 2
    slots = np.cumsum(_unplaned(raw[at:middle]), dtype=np.int32)
    return np.frombuffer(raw, np.float64, 1)[0], np.frombuffer(raw, np.int16, FACTS, 8), slots, _unplaned(raw[middle:])


def _batch(block: dict, taught: np.ndarray | None = None):
    """A record batch of one row. The slots are differences, which wrap around at a row's end."""
    import pyarrow as pa

    made = {}
    for n, kind in _TYPES.items():
        x = np.asarray(block[n]).astype(kind, copy=False)
        x = np.diff(x, prepend=np.int32(0)) if n == "slots" else x
        made[n] = pa.array([zlib.compress(_planes(x) if n in ("slots", "counts") else x.tobytes(), 1)], pa.binary())
    if taught is not None:
        made["taught"] = pa.array([zlib.compress(np.ascontiguousarray(taught, np.float32).tobytes(), 1)], pa.binary())
        for k, n in enumerate(("n_text", "n_meta")):
            made[n] = pa.array([int((~np.isnan(taught[:, k])).sum())], pa.int64())
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _read(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = {}
            for n in (*_TYPES, "taught"):
                if n in batch.schema.names:
                    raw = zlib.decompress(batch.column(n)[i].as_py())
                    block[n] = _unplaned(raw) if n in ("slots", "counts") else np.frombuffer(raw, _TYPES.get(n, np.float32))
            block["slots"] = np.cumsum(block["slots"], dtype=np.int32)
            yield block


def _views(block: dict) -> list[View]:
    """The last slot of each row's text view weighs 1."""
    starts = np.concatenate([[0], np.cumsum(block["size"], dtype=np.int64)])
    values = np.repeat(block["scale"].astype(np.float32), block["size"])
    values *= block["counts"]
    values[starts[1:] - 1] = 1.0
    facts = block["facts"].astype(np.int32)
    return [View(starts, block["slots"], values, TEXT_SIZE), View(np.arange(len(starts)) * FACTS, facts, np.ones(len(facts), np.float32), META_SIZE)]


def _take(block: dict, text: View, chosen: np.ndarray) -> dict:
    """Some rows of a block; text is its text view."""
    at = text.places(chosen)
    out = {n: block[n][chosen] for n in ("part", "target", "size", "scale")}
    return out | {"facts": block["facts"].reshape(-1, FACTS)[chosen].reshape(-1), "slots": block["slots"][at], "counts": block["counts"][at]}


def _binary(x: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["x"])


def _summed(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in df.collect():
        out += np.frombuffer(zlib.decompress(r["x"]), np.int64)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows of part, target and raw. A label's row has no raw and comes before the documents' rows of its part; a repeated id counts once."""

    def scan(batches: Iterator) -> Iterator:
        found, last, target, done = [], None, np.nan, False

        def made():
            scale, facts, slots, counts = zip(*(_unpacked(x[2]) for x in found), strict=True)
            return _batch({
                "part": np.array([x[0] for x in found], np.int64), "target": np.array([x[1] for x in found], np.float32), "size": np.array([len(x) for x in slots]),
                "scale": np.array(scale), "facts": np.concatenate(facts), "slots": np.concatenate(slots), "counts": np.concatenate(counts),
            })

        for batch in batches:
            for part, label, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "target", "raw")), strict=True):
                if part != last:
                    last, target, done = part, np.nan, False
                if raw is None:
                    target = label
                elif not done:
                    done = True
                    found.append((part, target, raw))
                    if len(found) == BLOCK:
                        yield made()
                        found.clear()
        if found:
            yield made()

    dealt = rows.repartition(partitions(rows.sparkSession), "part").sortWithinPartitions("part", "raw")
    return dealt.mapInArrow(scan, _BLOCK)


class Memo(dict):
    """What a function says of words, as bytes; cleared when it has MEMO words."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        self[word] = got = self.of(word)
        return got


def text_features(text: str, memo: Memo) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots of the text view, their counts and what a count weighs: each distinct word counts once, all together have length about 1.

    A word weighs as much as it has runs of letters. The last slot, for repeats, weighs 1.
    """
    words = text.split()
    distinct = set(words)
    if not distinct:
        return np.array([_slot("empty", TEXT_SIZE)], np.int32), np.ones(1, np.int32), 1.0
    slots = np.sort(np.frombuffer(b"".join(map(memo.__getitem__, distinct)), np.int32))
    runs = (len(slots) - len(distinct)) // 2
    first = np.flatnonzero(np.diff(slots, prepend=np.int32(-1)))
    counts = np.diff(first, append=len(slots))
    slots = np.append(slots[first], np.int32(repeat_feature(words, len(distinct))))
    return slots, np.append(counts, 1), runs**-0.5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", labelled: int = LABELLED, rounds: int = ROUNDS) -> Classifier | None:
    """A classifier from a sample of the labelled documents and all unlabelled ones; None without any labelled document.

    Of a document with several labels the worst counts; null labels don't. The sample is the documents of
    smallest id hash, the same in every run.
    """
    target = (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(target.cast("double").alias("target"))
    part = F.xxhash64(F.col(key), F.lit("quality")).alias("part")
    named = docs.where(F.col(key).isNotNull())
    labels_ = named.select(key).join(known, key).select(part, "target").distinct()
    first = [r["part"] for r in labels_.select("part").orderBy("part").limit(labelled).collect()]
    if not first:
        return None
    features = _features(named.select(part, "text", "source", "lang"))
    rows = features.withColumn("target", F.lit(None).cast("double")).unionByName(labels_.withColumn("raw", F.lit(None).cast("binary")))
    blocks = written(_blocks(rows), "quality")
    bound = first[-1]

    def sample(batches: Iterator) -> Iterator:
        for block in _read(batches):
            chosen = np.flatnonzero(~np.isnan(block["target"]) & (block["part"] <= bound))
            if len(chosen):
                yield _batch(_take(block, _views(block)[0], chosen))

    found = list(_read(blocks.mapInArrow(sample, _BLOCK).toArrow().to_batches()))
    whole = {n: np.concatenate([b.pop(n) for b in found]) for n in _TYPES}
    whole = _take(whole, _views(whole)[0], np.argsort(whole["part"]))
    return cotrain(*_views(whole), whole["target"].astype(np.float64), blocks, rounds)


def score(docs: DataFrame, classifier: Classifier | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_text, p_meta, score and keep. Null and empty texts are documents without words.

    Without a classifier every document scores 1 and stays. Columns of docs stay, but for such as have the
    names of the new ones; rows may repeat.
    """
    docs = docs.drop("p_text", "p_meta", "score", "keep")
    if classifier is None:
        one = F.lit(1.0)
        return docs.withColumns({"p_text": one, "p_meta": one, "score": one, "keep": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        weights, bias = own.text.tolist(), float(own.text[-1])
        meta = own.meta.tolist()

        def weighed(word: str) -> bytes:
            slots = word_features(word)
            return array("d", [sum([weights[s] for s in slots]), len(slots) // 2]).tobytes()

        memo = Memo(weighed)
        empty = weights[_slot("empty", TEXT_SIZE)] + bias
        for batch in batches:
            t, m = [], []
            for text, source, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang")), strict=True):
                words = (text or "").split()
                distinct = set(words)
                if distinct:
                    found = np.frombuffer(b"".join(map(memo.__getitem__, distinct)), np.float64)
                    own_words = float(np.sort(found[::2]).sum() / found[1::2].sum() ** 0.5)
                    t.append(own_words + weights[repeat_feature(words, len(distinct))] + bias)
                else:
                    t.append(empty)
                m.append(sum(meta[s] for s in meta_features(source, lang, text or "")) + meta[-1])
            columns = [*own.combine(np.array(t, np.float64), np.array(m, np.float64))]
            arrays = [pa.array(c, pa.float64()) for c in columns]
            arrays.append(pa.array(columns[2] >= threshold))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "p_text", "p_meta", "score", "keep"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(scan, f"{fields}, p_text double, p_meta double, score double, keep boolean")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document. Rows need text, source and lang; ids without labels are the rule."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_text", "p_meta", "score")], "keep")
