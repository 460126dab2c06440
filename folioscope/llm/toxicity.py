"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a bigram model that backs off to the class's words by their continuation counts (after
how many different words a word stands), and these to counts that both classes share: in how many documents of the whole
corpus a word is.  A rare expression, one with fewer than ``least`` occurrences in the labelled texts, isn't judged by
itself but by its stem, the first five bytes or else four, whose models back off to the classes' common counts; a rare stem
says nothing.  The shared counts by document and the stems are departures from Kneser-Ney, as is the curve over several
measures below: the plain models don't tell the classes apart well enough (figures in the README).

A text's evidence is the difference of the two log-likelihoods, normalised by length, over the whole text and over its
worst stretch of ``stretch`` words; a logistic curve, fitted on labelled texts that the models haven't seen, turns it
into a score in [0, 1].

What is learned from labels is learned from a bounded sample, ``per_class`` rows of each class by hash of the id, so the
models' size is bounded and they can be broadcast.  The shared counts cover all documents.

Defined cases: null and empty texts have no evidence, and the score of none; rows without a known label, and held-out
rows, are scored and never learned from; with a class missing in the fold that fits the curve, the models' own texts fit
it; ids that are null are scored, and count as not held out; rows that share an id
are scored each; several labels of one id count as toxic if one is; with one class missing all scores are 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_buffers, drop_staged, hashed_words, mix, pieces, staged, text_bytes


@dataclass(frozen=True)
class Settings:
    per_class: int = 8192  # labelled rows of each class that are learned from, at most
    per_class_fit: int = 4096  # labelled rows of each class that fit the curve, at most
    least: int = 3
    stretch: int = 32
    stretch_step: int = 8


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right)


def _bare(data: np.ndarray) -> np.ndarray:
    """ASCII marks other than the apostrophe become spaces, so that a word is the same with and without them."""
    return _BARE[data]


_BARE = np.arange(256, dtype=np.uint8)
_BARE[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 32


_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
STEMS = (5, 4)  # bytes


def _stems(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` bytes of each word, A-Z as a-z, as a mixed number."""
    out = np.full(len(starts), k, np.uint64)
    for j in range(k):
        at = starts + j
        out = out << np.uint64(8) | np.where(at < ends, _LOW[b[np.minimum(at, len(b) - 1)]], np.uint64(0))
    return mix(out)


def _units(column) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Row and units of each text of a column: hashes of words, of bigrams (as many less one), and of stems."""
    data, offsets = binary_buffers(column)
    for a, b in pieces(offsets):
        lo = offsets[a]
        bare = _bare(data[lo : offsets[b]])
        h, starts, ends, of = hashed_words(bare, offsets[a : b + 1] - lo)
        two = _pair(h[:-1], h[1:]) if len(h) > 1 else h[:0]
        stems = [_stems(bare, starts, ends, k) if len(h) else h for k in STEMS]
        for i in range(b - a):
            s, e = of[i], of[i + 1]
            yield a + i, (h[s:e], two[s : max(s, e - 1)], *(x[s:e] for x in stems))


WORD, PAIR = 0, 1  # kinds of units; stems are 2 and 3
CLASSES = ("n_toxic", "n_ordinary")
CONTINUED = ("c_toxic", "c_ordinary")


def _class_counts(texts: DataFrame) -> DataFrame:
    """``bytes, toxic`` to ``gram, kind, left, right, n_toxic, n_ordinary``: counts of all units; ``left, right``: a bigram's words.

    Tasks add up what a batch holds, and an aggregation the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            got: dict[tuple, list] = {}
            firsts, seconds = 2 + len(STEMS), 3 + len(STEMS)
            for i, units in _units(batch.column(0)):
                for kind, u in enumerate((*units, units[0][:-1], units[0][1:])):  # the last two: bigrams' words
                    got.setdefault((kind, toxic[i]), []).append(u)
            for (kind, is_toxic), parts in got.items():
                grams = np.concatenate(parts)
                if kind >= firsts or not len(grams):
                    continue
                gram, at, n = np.unique(grams, return_index=True, return_counts=True)
                left, right = (np.concatenate(got[k, is_toxic])[at] if kind == PAIR else np.zeros(len(gram), np.uint64) for k in (firsts, seconds))
                n = n.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (gram, left, right)), pa.array(np.full(len(gram), kind, np.int32)), pa.array(n * is_toxic), pa.array(n * (not is_toxic))],
                    names=["gram", "left", "right", "kind", "n_toxic", "n_ordinary"],
                )

    found = texts.select("bytes", "toxic").mapInArrow(run, "gram long, left long, right long, kind int, n_toxic long, n_ordinary long")
    return found.groupBy("gram", "kind").agg(F.first("left").alias("left"), F.first("right").alias("right"), *[F.sum(c).alias(c) for c in CLASSES])


def _continuations(counts: DataFrame) -> DataFrame:
    """``gram, c_toxic, c_ordinary``: after how many different words each word stands, in each class."""
    pairs = counts.filter(F.col("kind") == PAIR)
    return pairs.groupBy(F.col("right").alias("gram")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(k) for c, k in zip(CLASSES, CONTINUED, strict=True)])


def shared_counts(docs: DataFrame) -> DataFrame:
    """``gram, docs``: in how many documents each word of the corpus is. Added up by batch, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(units[0]) for _, units in _units(batch.column(0))]
            if each:
                gram, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "docs"])

    return docs.select(text_bytes().alias("bytes")).mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


class Model:
    """Both classes' models as sorted arrays: log ratios of the words, bigrams and stems that have a class of their own."""

    def __init__(self, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray], stems: list[dict[str, np.ndarray]], totals: dict, spectrum: dict):
        order = np.argsort(words["gram"])
        self.word = words["gram"][order]
        counts = {c: words[c][order].astype(float) for c in CLASSES}
        after = {c: words[k][order].astype(float) for c, k in zip(CLASSES, CONTINUED, strict=True)}
        p, rest = self.backed_off(after, WORD, (words["docs"][order] + 1.0) / totals["docs"], totals, spectrum)
        self.ratio = np.log(p["n_toxic"]) - np.log(p["n_ordinary"])
        self.unseen = float(np.log(rest["n_toxic"]) - np.log(rest["n_ordinary"]))
        self.stems = []
        for kind, t in enumerate(stems, 2):
            order = np.argsort(t["gram"])
            n = {c: t[c][order].astype(float) for c in CLASSES}
            both = sum(n.values()) / max(1.0, sum(totals.get((c, kind), 0.0) for c in CLASSES))
            q, _ = self.backed_off(n, kind, both, totals, spectrum)
            self.stems.append((t["gram"][order], np.log(q["n_toxic"]) - np.log(q["n_ordinary"])))
        # bigrams of words that have a class of their own; a context's count is its word's
        order = np.argsort(pairs["gram"])
        left, right = np.searchsorted(self.word, pairs["left"][order]), np.searchsorted(self.word, pairs["right"][order])
        logs = []
        for c in CLASSES:
            d = self.discount(spectrum, PAIR, c)
            n = pairs[c][order].astype(float)
            context = np.maximum(counts[c][left], n)
            followers = np.maximum(pairs[f"k_{c}"][order], 1).astype(float)  # different words seen after the first
            seen = context > 0
            weight = np.where(seen, np.minimum(1.0, d * followers / np.maximum(context, 1)), 1.0)
            logs.append(np.log(np.where(seen, np.maximum(n - d, 0) / np.maximum(context, 1), 0) + weight * p[c][right]))
        self.pair, self.pair_ratio = pairs["gram"][order], logs[0] - logs[1]
        self.curve = np.zeros(1 + N_FEATURES)

    @classmethod
    def backed_off(cls, counts: dict, kind: int, shared: np.ndarray, totals: dict, spectrum: dict) -> tuple[dict, dict]:
        """Each class's probabilities: counts less the Kneser-Ney discount, and what was taken off by the shared counts."""
        p, rest = {}, {}
        for c, n in counts.items():
            total = max(totals.get((c, kind), 0.0), 1.0)
            kept = np.maximum(n - cls.discount(spectrum, kind, c), 0.0)
            rest[c] = max(1e-6, 1.0 - kept.sum() / total)  # with all that is too rare to stand for itself
            p[c] = kept / total + rest[c] * shared
        return p, rest

    @staticmethod
    def discount(spectrum: dict, kind: int, c: str) -> float:
        n1, n2 = spectrum.get((kind, c, 1), 0), spectrum.get((kind, c, 2), 0)
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    def ratios(self, units: tuple[np.ndarray, ...]) -> np.ndarray:
        """Each word's log ratio, given the word before; of a rare word, its stem's."""
        one, two, *stems = units
        out = np.full(len(one), self.unseen)
        tables = [(x, g, r) for x, (g, r) in zip(stems[::-1], self.stems[::-1], strict=True)] + [(one, self.word, self.ratio)]
        for x, gram, ratio in tables:
            if len(gram):
                at = np.minimum(np.searchsorted(gram, x), len(gram) - 1)
                out = np.where(gram[at] == x, ratio[at], out)
        if len(self.pair) and len(two):
            at = np.minimum(np.searchsorted(self.pair, two), len(self.pair) - 1)
            out[1:] = np.where(self.pair[at] == two, self.pair_ratio[at], out[1:])
        return out

    def features(self, units: tuple[np.ndarray, ...], how: Settings) -> np.ndarray:
        """The whole text's mean log ratio, its worst stretch's, and its highest words'; last, the length."""
        if not len(units[0]):
            return np.zeros(N_FEATURES)
        r = self.ratios(units)
        sums = np.concatenate(([0.0], np.cumsum(r)))
        n, m = len(r), min(len(r), how.stretch)
        starts = np.minimum(np.arange(0, max(1, n - m + how.stretch_step), how.stretch_step), n - m)
        worst = (sums[starts + m] - sums[starts]).max() / how.stretch
        high = np.sort(r)[::-1][:4]
        return np.array([r.mean(), worst, high[0] / 8, high.sum() / 32 if len(high) == 4 else high[0] / 32, np.log1p(n) / 8])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)))


N_FEATURES = 5


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic curve that rises with every measure of toxicity: measures that would lower it are left out, one by one."""
    use = list(range(N_FEATURES))
    while True:
        w = _newton(x[:, use], y, weight)
        low = min(((w[1 + k], f) for k, f in enumerate(use) if f < N_FEATURES - 1), default=(0, 0))
        if low[0] >= 0:
            out = np.zeros(1 + N_FEATURES)
            out[[0, *(1 + f for f in use)]] = w
            return out
        use.remove(low[1])


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(labels: DataFrame, folds: tuple[int, ...], per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")).isin(*folds))
    part = lambda c: one.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return part(1).unionByName(part(0)).select("doc_id", (F.col("toxic") == 1).alias("toxic"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> Model | None:
    """The models and the curve. Folds 0 and 1 give counts, fold 3 the curve; fold 2 is held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    labelled = lambda folds, n: texts.join(F.broadcast(_sample(labels, folds, n)), "doc_id")  # noqa: E731  the sample's size is bounded
    counts = staged(spark, _class_counts(labelled((0, 1), how.per_class)), "grams")
    continued = staged(spark, _continuations(counts), "continued")
    spectrum, totals = {}, {}
    for c, k in zip(CLASSES, CONTINUED, strict=True):
        of_words = continued.filter(F.col(k) > 0).select(F.lit(WORD).alias("kind"), F.col(k).alias("n"))
        others = counts.filter((F.col("kind") != WORD) & (F.col(c) > 0)).select("kind", F.col(c).alias("n"))
        for row in of_words.unionByName(others).groupBy("kind").agg(F.sum("n").alias("n"), *[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2)]).collect():
            totals[c, row["kind"]] = float(row["n"])
            spectrum[row["kind"], c, 1], spectrum[row["kind"], c, 2] = row["n1"], row["n2"]
    if not all(totals.get((c, WORD)) for c in CLASSES):
        return None
    corpus = staged(spark, shared_counts(docs), "shared")
    totals["docs"] = float(corpus.agg(F.sum("docs")).first()[0])
    common = counts.filter(F.col("n_toxic") + F.col("n_ordinary") >= how.least)
    kind = lambda k: common.filter(F.col("kind") == k)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    words = kind(WORD).join(corpus, "gram", "left").join(continued, "gram", "left").select("gram", *CLASSES, *map(zero, (*CONTINUED, "docs")))
    followers = counts.filter(F.col("kind") == PAIR).groupBy("left").agg(*[F.sum((F.col(c) > 0).cast("long")).alias(f"k_{c}") for c in CLASSES])
    pairs = kind(PAIR).join(followers, "left").select("gram", "left", "right", *CLASSES, "k_n_toxic", "k_n_ordinary")
    tables = [words, pairs, *(kind(2 + k).select("gram", *CLASSES) for k in range(len(STEMS)))]
    w, p, *stems = (_arrays(t.toArrow()) for t in tables)  # as many rows as the bounded sample has frequent expressions
    model = Model(w, _known(p, np.sort(w["gram"])), stems, totals, spectrum)
    drop_staged(spark, counts, continued, corpus)
    sent = spark.sparkContext.broadcast(model)
    for folds in ((3,), (0, 1)):  # with a class missing in fold 3, on the models' own texts
        fit = _features(labelled(folds, how.per_class_fit).select("bytes", "toxic"), sent, how).toArrow()
        x, y = np.stack(fit["x"].to_numpy()) if fit.num_rows else np.zeros((0, N_FEATURES)), fit["toxic"].to_numpy().astype(float)
        if 0 < y.sum() < len(y):
            break
    share = _toxic_share(labels)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.curve = _fit(x, y, weight)
    return model


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t[c].to_numpy().view(np.uint64) if c in ("gram", "left", "right") else t[c].to_numpy() for c in t.column_names}


def _toxic_share(labels: DataFrame) -> float:
    got = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id").cast("long")) != 2)).agg(F.avg("toxic")).first()[0]
    return float(got or 0)


def _known(pairs: dict[str, np.ndarray], words: np.ndarray) -> dict[str, np.ndarray]:
    """The bigrams with both words in ``words``."""
    known = lambda x: words[np.minimum(np.searchsorted(words, x), len(words) - 1)] == x if len(words) else np.zeros(len(x), bool)
    keep = known(pairs["right"]) & known(pairs["left"])
    return {c: v[keep] for c, v in pairs.items()}


def _features(texts: DataFrame, sent, how: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            model = sent.value
            x = [model.features(units, how).tolist() for _, units in _units(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return texts.mapInArrow(run, "toxic boolean, x array<double>")


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    own = F.col("doc_id").cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(own.isNotNull() & (fold(own) == 2), F.lit(False)).alias("held_out"), text_bytes().alias("bytes"))
    model = train(spark, docs, labels, how)
    if model is None:
        score = F.lit(0.0)
        return rows.select("doc_id", "held_out", score.alias("score"), F.lit(0).alias("predicted"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = sent.value
            x = np.array([m.features(units, how) for _, units in _units(batch.column(2))]).reshape(-1, N_FEATURES)
            s = m.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
