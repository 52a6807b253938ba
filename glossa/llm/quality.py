"""Quality classifier by co-training on two views of a document.

One view has the text's words and shape, the other its metadata. Both start from the
labelled documents; over some rounds each gives the other its confident labels of the
documents without one. Their calibrated scores are then combined, and every document is
scored.

Training takes all documents, labelled or not, and whole texts: views have a fixed size,
and losses and gradients are sums over the table, so only sums reach the driver.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import Scratch, bounded_batches

TEXT_PLACES, META_PLACES = 1 << 16, 1 << 10
ROUNDS = 2
CONFIDENT = 0.98
#: Weight of all exchanged labels of a kind in the last round, to that of the given ones.
SHARE = 0.5
RIDGE = 5e-5
STEM, FORMS = 5, (2, 3, 5)  # a word's first letters, and numbers of distinct words that share them
#: The combination leans to half of either logit as if by so many rows, and no view counts less than this or against its own labels.
MIX_ROWS, MIX_LEAST = 5, 0.1
STEPS, MORE_STEPS, LEAST_GAIN = 40, 15, 1e-4
MOST_BYTES = 32 << 20
HELD_OUT = 5  # one labelled document of so many calibrates
SMALL = 50  # a kind with fewer labels isn't held out: all of it calibrates by cross-fitting
REJECT_BELOW = 0.5
_SYMBOLS = re.compile(r"[^\w\s]+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Places(dict):
    """Place of a feature in a view; a memo, emptied when it is large."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[name] = found = xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % self.size
        return found


def text_features(text: str | None, places: Places) -> set[int]:
    """Places of the words, of stems that several words share, of the symbols at words, and of the text's shape."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    plain = {x.lower().strip(_EDGE) for x in distinct}
    found = {places[w] for w in plain if w}
    for stem, n in Counter([w[:STEM] for w in plain if len(w) > STEM]).items():
        found |= {places[f"stem {stem} {k}"] for k in FORMS if n >= k}
    found |= {places["symbols " + s] for s in set(_SYMBOLS.findall(" ".join(distinct)))}
    n, letters = len(words), len(text)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(not w[-1].isalnum() for w in words)
    for name, share in (("distinct", len(distinct) / max(1, n)), ("upper", upper / max(1, n)), ("marked", marked / max(1, n))):
        found.add(places[f"{name} {math.floor(10 * share)}"])
    found.add(places[f"words {n.bit_length()}"])
    found.add(places[f"word length {round(letters / max(1, n))}"])
    return found


def meta_features(lang: str | None, source: str | None, n_chars: int | None, places: Places) -> set[int]:
    return {places[f"lang {lang}"], places[f"source {source}"], places[f"lang {lang} source {source}"], places[f"chars {None if n_chars is None else int(n_chars).bit_length()}"]}


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, lang, source, n_chars) to (id, words, meta); places as 16-bit numbers."""
    of_text, of_meta = Places(TEXT_PLACES), Places(META_PLACES)
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(1, 5))))
        words = [np.fromiter(text_features(t, of_text), np.uint16).tobytes() for t, *_ in rows]
        meta = [np.fromiter(meta_features(*x, of_meta), np.uint16).tobytes() for _, *x in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(meta, pa.binary())], names=["id", "words", "meta"])


@dataclass(frozen=True)
class View:
    """Weights of one view; its size is fixed, whatever the corpus."""

    weights: np.ndarray
    bias: float

    def logit(self, places) -> float:
        return self.bias + float(self.weights[list(places)].sum())


class Rows:
    """A batch of (id, good, words, meta, fold): places of all rows in one array and where each row starts; no row is without any."""

    def __init__(self, batch: pa.RecordBatch):
        self.good = batch.column("good").fill_null(-1).to_numpy(zero_copy_only=False)
        self.fold = batch.column("fold").to_numpy(zero_copy_only=False)
        self.views = [self._places(batch.column(c)) for c in ("words", "meta")]

    @staticmethod
    def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint16)
        return flat, (ends - ends[0]) // 2

    def logits(self, views: tuple[View, View]) -> list[np.ndarray]:
        return [v.bias + np.add.reduceat(v.weights[flat].astype(np.float64), ends[:-1]) for v, (flat, ends) in zip(views, self.views)]


def _summed(rows: DataFrame, parts: int, of: Callable[[Rows], np.ndarray], width: int) -> np.ndarray:
    """The sum of of(batch) over all batches: one part of it a task, few tasks a core, and executors add up what is too much for the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(Rows(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = min(parts, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    found = rows.coalesce(max(1, parts)).mapInArrow(first, "sums binary")
    if parts * width * 8 > MOST_BYTES:
        found = found.repartition(math.isqrt(parts)).mapInArrow(again, "sums binary")
    return np.sum([np.frombuffer(r.sums) for r in found.collect()], axis=0) if parts else np.zeros(width)


def _minimised(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS; value gives a convex function and its gradient."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(past):
            back.append(a := s @ d / (s @ y))
            d = d - a * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(back)):
            d = d + s * (a - y @ d / (s @ y))
        step = 1.0 if past else 1 / max(1e-12, float(np.linalg.norm(g)))
        while True:
            f2, g2 = value(x + step * d)
            if f2 <= f + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 2
        if f2 >= f:
            break
        if (step * d) @ (g2 - g) > 0:
            past = [*past[-9:], (step * d, g2 - g)]
        x, gain, f, g = x + step * d, f - f2, f2, g2
        if gain < LEAST_GAIN * f:
            break
    return x


_SIZES = (TEXT_PLACES, META_PLACES)


def _views(x: np.ndarray) -> tuple[View, View]:
    return View(x[:TEXT_PLACES].astype(np.float32), float(x[TEXT_PLACES])), View(x[TEXT_PLACES + 1 : -1].astype(np.float32), float(x[-1]))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _taught(rows: Rows, teachers: tuple[View, View]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For either view, the other's logits and which of them are confident labels of rows without one."""
    edge = math.log(CONFIDENT / (1 - CONFIDENT))
    return [(z, (rows.good < 0) & (np.abs(z) >= edge)) for z in reversed(rows.logits(teachers))]


def _fitted(rows: DataFrame, parts: int, x: np.ndarray, steps: int, teachers=None, share: float = 0.0, without: tuple[int, ...] = (-1,)) -> np.ndarray:
    """Both views by logistic regression, over given labels (but fold `without`, and one after the other for each of these) and the teachers' confident ones.

    A confident label counts as its probability. All rows with one take part; their
    weight is such that those of a kind have at most `share` of the weight of the given.
    """

    def given(r: Rows) -> np.ndarray:
        mine = r.good[(r.good >= 0) & ~np.isin(r.fold, without[:1])]
        counts = [(mine == 0).sum(), (mine == 1).sum()]
        for z, sure in _taught(r, teachers):
            counts += [(sure & (z < 0)).sum(), (sure & (z > 0)).sum()]
        return np.array(counts, np.float64)

    weights = [(0.0, 0.0)] * 2
    if teachers:
        n = _summed(rows, parts, given, 6)
        weights = [tuple(min(1.0, share * n[k] / max(1.0, n[2 + 2 * v + k])) for k in (0, 1)) for v in (0, 1)]
    else:
        rows = rows.where("good is not null")
    width = len(x) // len(without)

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        each = [_views(part) for part in at.reshape(-1, width)]

        def of(r: Rows) -> np.ndarray:
            found = []
            taught = _taught(r, teachers) if teachers else [None] * 2
            for views, fold in zip(each, without):
                sums, grads = [], []
                for size, z, (flat, ends), other, (if_bad, if_good) in zip(_SIZES, r.logits(views), r.views, taught, weights):
                    weight, target = ((r.good >= 0) & (r.fold != fold)).astype(np.float64), r.good.astype(np.float64)
                    if other:
                        weight = np.where(other[1], np.where(other[0] > 0, if_good, if_bad), weight)
                        target = np.where(other[1], _sigmoid(other[0]), target)
                    rest = weight * (_sigmoid(z) - target)
                    sums += [(weight * (np.logaddexp(0, z) - target * z)).sum(), weight.sum()]
                    grads += [np.bincount(flat, np.repeat(rest, np.diff(ends)), size), [rest.sum()]]
                found += [sums, *grads]
            return np.concatenate(found)

        f, slope = 0.0, []
        for part, total in zip(at.reshape(-1, width), _summed(rows, parts, of, (4 + width) * len(without)).reshape(-1, 4 + width)):
            n_text, n_meta = max(1.0, total[1]), max(1.0, total[3])
            kept = part.copy()
            kept[[TEXT_PLACES, -1]] = 0  # no ridge on the constants
            f += total[0] / n_text + total[2] / n_meta + RIDGE / 2 * float(kept @ kept)
            slope.append(total[4:] / np.repeat([n_text, n_meta], [z + 1 for z in _SIZES]) + RIDGE * kept)
        return f, np.concatenate(slope)

    return _minimised(value, x, steps)


def _mixed(rows: DataFrame, parts: int, views: dict[int, tuple[View, View]]) -> tuple[float, float, float]:
    """Weights of both logits and the constant, by logistic regression over labelled rows that the views of their folds haven't learned from."""
    centre, both = np.array([0.5, 0.5, 0.0]), np.array([1.0, 1.0, 0.0])

    def value(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of(r: Rows) -> np.ndarray:
            total = np.zeros(14)
            for fold, pair in views.items():
                mine = r.fold == fold
                x = np.stack([*(z[mine] for z in r.logits(pair)), np.ones(mine.sum())])
                z, good = at @ x, r.good[mine]
                p = _sigmoid(z)
                total += np.concatenate([[mine.sum(), (np.logaddexp(0, z) - good * z).sum()], x @ (p - good), ((x * (p * (1 - p))) @ x.T).ravel()])
            return total

        t = _summed(rows, parts, of, 14)
        n = max(1.0, t[0])
        ridge = both * MIX_ROWS / n
        return t[1] / n + float(ridge @ (at - centre) ** 2) / 2, t[2:5] / n + ridge * (at - centre), t[5:].reshape(3, 3) / n + np.diag(ridge + 1e-9)

    rows = rows.where("good is not null").where(F.col("fold").isin(list(views)))
    at, least = centre, np.array([MIX_LEAST, MIX_LEAST, -np.inf])
    f, g, h = value(at)
    for _ in range(15):
        free = (at > least) | (g < 0)
        step = np.zeros(3)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        while (found := value(to := np.maximum(least, at - step)))[0] > f and np.abs(step).max() > 1e-6:
            step = step / 2
        if found[0] >= f:
            break
        at, gain, (f, g, h) = to, f - found[0], found
        if gain < 1e-7:
            break
    return tuple(float(x) for x in at)


@dataclass(frozen=True)
class Classifier:
    text: View
    meta: View
    #: Of the text view's logit, of the metadata view's and the constant: calibrated and combined.
    mix: tuple[float, float, float]

    def score(self, text, lang, source, n_chars, of_text, of_meta) -> float:
        z = self.mix[0] * self.text.logit(text_features(text, of_text)) + self.mix[1] * self.meta.logit(meta_features(lang, source, n_chars, of_meta)) + self.mix[2]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def featured(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """id, good, words, meta: one row per row of docs, good being null without a label."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.when(bad, 0).otherwise(1)).alias("good"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(_featured, "id long, words binary, meta binary")
    return scratch.save(rows.join(known.withColumnRenamed("doc_id", "id"), "id", "left").select("id", "good", "words", "meta"))


def _with_folds(rows: DataFrame) -> tuple[DataFrame, bool, dict[int, int]]:
    """rows with their fold, whether every fold must calibrate, and the number of labels by kind.

    A kind is held out by a hash of the id. If one is too small for that, its documents
    are dealt to the folds in turn, so that no fold has all of them.
    """
    by_hash = F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(HELD_OUT)).cast("int")
    counts = rows.where("good is not null").groupBy("good", (by_hash == 0).alias("held")).agg(F.count("*").alias("n")).collect()
    kinds: dict[int, int] = {}
    for r in counts:
        kinds[r.good] = kinds.get(r.good, 0) + r.n
    held = {r.good: r.n for r in counts if r.held}
    fold = by_hash
    few = [k for k, n in kinds.items() if n < SMALL]
    for kind in few:
        ids = [r.id for r in rows.where(F.col("good") == kind).select("id").distinct().orderBy("id").collect()]  # fewer than SMALL
        for i in range(HELD_OUT):
            fold = F.when((F.col("good") == kind) & F.col("id").isin(ids[i::HELD_OUT]), i).otherwise(fold)
    return rows.withColumn("fold", F.coalesce(fold, F.lit(0))), bool(few) or min((held.get(k, 0) for k in kinds), default=0) < SMALL // HELD_OUT // 2, kinds


def _trained(rows: DataFrame, rounds: int) -> Classifier | None:
    rows, crossed, kinds = _with_folds(rows)
    if not kinds:
        warnings.warn("no document has a label: all are kept", stacklevel=3)
        return None
    if len(kinds) < 2:
        raise ValueError(f"all {sum(kinds.values())} labelled documents are {'good' if 1 in kinds else 'bad'}: a classifier needs both kinds")
    parts = rows.rdd.getNumPartitions()
    start = np.zeros(sum(_SIZES) + 2)
    without = (-1,) if crossed else (0,)
    x = _fitted(rows, parts, start, STEPS, without=without)
    teachers, share = None, 0.0
    for k in range(rounds):
        teachers, share = _views(x), SHARE * (k + 1) / rounds
        x = _fitted(rows, parts, x, MORE_STEPS, teachers, share, without)
    text, meta = _views(x)
    if min(kinds.values()) < 2:
        # Nothing is left to calibrate by: the views count as independent, and their common prior once.
        return Classifier(text, meta, (1.0, 1.0, -math.log(kinds[1] / kinds[0])))
    folds = {0: (text, meta)}
    if crossed:
        every = _fitted(rows, parts, np.tile(start, HELD_OUT), STEPS, teachers, share, tuple(range(HELD_OUT)))
        folds = {i: _views(part) for i, part in enumerate(every.reshape(HELD_OUT, -1))}
    return Classifier(text, meta, _mixed(rows, parts, folds))


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Classifier | None:
    """None, with a warning, if no document at hand has a label; an error if their labels are of one kind only.

    A label is good if quality is 1 and toxic is 0, a null in either counting as such;
    of labels that repeat an id the worst counts. Rows with a null id have no label.
    """
    scratch = Scratch(docs.sparkSession)
    rows = featured(docs, labels, scratch)
    found = _trained(rows, rounds)
    scratch.drop(rows)
    return found


def _scored(rows: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score of the rows of featured()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta = Rows(batch).logits((model.text, model.meta))
                found = _sigmoid(model.mix[0] * text + model.mix[1] * meta + model.mix[2])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return rows.withColumn("fold", F.lit(0)).mapInArrow(run, "doc_id long, score double")


def trained_and_scored(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """score() of docs by train() on them; their features are found once."""
    rows = featured(docs, labels, Scratch(docs.sparkSession))
    model = _trained(rows, rounds)
    return score(docs, None) if model is None else _scored(rows, model)


def score(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, score: one row per input row; score is the probability of a good document.

    Null texts and metadata are scored by what is left of them. Without a model every
    score is 1. Extra columns are ignored; repeated and null ids stay as they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long"))
    if model is None:
        return rows.select("doc_id", F.lit(1.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text, of_meta = Places(TEXT_PLACES), Places(META_PLACES)
        for batch in batches:
            found = [model.score(*x, of_text, of_meta) for x in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Classifier | None, least: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs, with its columns, whose score is at least `least`."""
    if model is None:
        return docs
    at = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text, of_meta = Places(TEXT_PLACES), Places(META_PLACES)
        for batch in batches:
            scores = [model.score(*x, of_text, of_meta) for x in zip(*(batch.column(i).to_pylist() for i in at))]
            yield batch.filter(pa.array([s >= least for s in scores], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_co_training(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return trained_and_scored(docs, labels).withColumn("kept", F.col("score") >= REJECT_BELOW)
