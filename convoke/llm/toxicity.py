"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon is learnt from labelled texts: whole words and beginnings of words that are many times more frequent, by
documents, in toxic texts than in others. The features are densities of its hits (as written and after undoing
look-alike spelling), their nearness to words of the second person, and rates of capitals, punctuation and obfuscated
words. Lexicon, trees and calibration are fitted on a sample of about ``SAMPLE`` labelled rows chosen by a hash of the
id, never on held-out ones; all documents are scored, in the tasks that read them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import held, table, written

#: Labelled rows that models are fitted on, about; entries of the lexicon at most.
SAMPLE, ENTRIES = 20_000, 4_000
#: Lengths of the beginnings that can enter the lexicon.
HEADS = (4, 5, 6)
#: Documents of a toxic entry at least, and how many times more frequent (as a logarithm) it must be in toxic ones.
SUPPORT, ODDS = 6, 3.0
REMEMBERED = 300_000
NEAR = 6
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
PLAIN = str.maketrans("0134578@$!|€", "oieastbasiie")
EDGES = ".,;:!?\"'()[]{}<>«»„“”‚‘’…–—-_*#¿¡"
ODD = re.compile(r"[^\W\d_][*@$!|0-9.\-_#]+[^\W\d_]|(.)\1{3,}")
FEATURES = (
    "hits", "log_hits", "kinds", "weight", "strongest", "hidden_hits", "near_second", "second", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "log_words",
)


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


def forms(word: str) -> list[str]:
    """What can enter the lexicon for a bare word: itself, and its beginnings (marked)."""
    return [word, *(f"{word[:k]}*" for k in HEADS if len(word) > k)] if len(word) > 2 else []


class Lexicon(dict):
    """Looks up raw words: (weight, hit, hidden hit, second person, shouted, obfuscated); remembers what it has seen."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in forms(word)), default=0.0)

    def __missing__(self, raw: str) -> int:
        """The flags as one number that adds up: 24 bits for each count."""
        word = bare(raw)
        hit = self.weight(word) > 0
        odd = bool(ODD.search(raw.strip(EDGES)))
        hidden = not hit and (odd or not word.isalpha()) and self.weight(self.plain(word)) > 0
        out = int(hit or hidden) | int(hidden) << 24 | int(word in SECOND) << 48 | int(len(word) > 2 and raw.isupper()) << 72 | int(odd) << 96
        if len(self) > REMEMBERED:
            self.clear()
        self[raw] = out
        return out

    @staticmethod
    def plain(word: str) -> str:
        """Look-alike signs as letters, signs between letters dropped, letters repeated more than twice once."""
        word = re.sub(r"[*.\-_#]", "", word.translate(PLAIN))
        return re.sub(r"(.)\1{2,}", r"\1", word)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; a hundred texts at a time."""
    held("toxicity")
    parts = [_features(texts.slice(at, 100), lexicon) for at in range(0, len(texts), 100)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    data, ends = anchors.buffers(texts)
    begins = np.concatenate(([0], ends[:-1]))
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.stack((begins, ends))], axis=0)[0]
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    sign = (data > 32) & (data < 128) & ~upper & ~lower & ~((data >= 48) & (data <= 57))
    n_upper, n_lower, n_sign, n_bang = total(upper), total(lower), total(sign), total(data == 33)
    out = np.zeros((len(ends), len(FEATURES)))
    mask = (1 << 24) - 1
    for i, text in enumerate(texts.to_pylist()):
        words = text.split()
        flags = sum(map(lexicon.__getitem__, words))
        n = max(len(words), 1)
        hits = flags & mask
        kinds = weight = strongest = near = 0
        if hits:
            at = [k for k, w in enumerate(words) if lexicon[w] & 1]
            weights = [max(lexicon.weight(bare(words[k])), lexicon.weight(lexicon.plain(bare(words[k])))) for k in at]
            kinds, weight, strongest = len({bare(words[k])[:5] for k in at}), sum(weights) / len(at), max(weights)
            if flags >> 48 & mask:
                second = np.array([k for k, w in enumerate(words) if lexicon[w] >> 48 & 1])
                near = int(sum(np.abs(second - k).min() <= NEAR for k in at))
        size = max(int(ends[i] - begins[i]), 1)
        out[i] = (
            hits / n, np.log1p(hits), kinds, weight, strongest, (flags >> 24 & mask) / n, near / n, (flags >> 48 & mask) / n,
            n_upper[i] / max(int(n_upper[i] + n_lower[i]), 1), (flags >> 72 & mask) / n, n_bang[i] / size, n_sign[i] / size, (flags >> 96 & mask) / n, np.log1p(len(words)),
        )
    return out


class Trees:
    """Gradient-boosted trees for a 0/1 label: logistic loss, Newton steps, histograms of quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6), cuts)
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list) -> tuple[tuple, np.ndarray]:
        """A complete tree as (features, thresholds, leaf values), and the rows' leaves. Splits without gain send all left."""
        inner = (1 << self.depth) - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key, width = (node - first) * (len(cut) + 1) + binned[:, f], len(cut) + 1
                sg, sh = (np.bincount(key, w, count * width).reshape(count, width) for w in (g, h))
                lg, lh = sg.cumsum(1)[:, :-1], sh.cumsum(1)[:, :-1]
                tg, th = sg.sum(1, keepdims=True), sh.sum(1, keepdims=True)
                gain = lg**2 / (lh + self.ridge) + (tg - lg) ** 2 / (th - lh + self.ridge) - tg**2 / (th + self.ridge)
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], feature[first + k], threshold[first + k] = top[k], f, cut[at[k]]
            for k in range(count):
                own = np.flatnonzero(node == first + k)
                f, t = feature[first + k], threshold[first + k]
                right = binned[own, f] > (np.searchsorted(cuts[f], t, "left") if np.isfinite(t) else len(cuts[f]) + 1)
                node[own] = 2 * (first + k) + 1 + right
        leaf = node - inner
        sg, sh = (np.bincount(leaf, w, inner + 1) for w in (g, h))
        return (feature, threshold, -self.rate * sg / (sh + self.ridge)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing step function of x nearest to y, as the steps' middles and heights."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []  # sum of y, rows, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        steps.append([b, 1, a, a])
        while len(steps) > 1 and (steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1] or steps[-2][3] == steps[-1][2]):
            last = steps.pop()
            steps[-1] = [steps[-1][0] + last[0], steps[-1][1] + last[1], steps[-1][2], last[3]]
    return np.array([(s[2] + s[3]) / 2 for s in steps]), np.array([s[0] / s[1] for s in steps])


class Model:
    """Scores texts between 0 and 1."""

    def __init__(self, weights: dict[str, float], trees: Trees, steps: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.steps = Lexicon(weights), trees, steps

    def score(self, texts: pa.Array) -> np.ndarray:
        margin = self.trees.margin(features(texts, self.lexicon))
        level = np.interp(margin, *self.steps)
        # A hundredth of the uncalibrated probability keeps the order within a step.
        return 0.99 * level + 0.01 / (1 + np.exp(-margin))


def _toxic_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            count.update({f for w in text.split() for f in forms(bare(w))})
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["form", "n"])


def _counting(wanted):
    """Documents of a task that hold each of the wanted forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, count = wanted.value, Counter()
        of: dict[str, tuple] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found: set = set()
                for w in text.split():
                    got = of.get(w)
                    if got is None:
                        if len(of) > REMEMBERED:
                            of.clear()
                        got = of[w] = tuple(f for f in forms(bare(w)) if f in names)
                    found.update(got)
                count.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["form", "n"])

    return run


def learnt_lexicon(sample: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Forms with their log odds. sample: text, toxic."""
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    seen = sample.where("toxic = 1").select("text").mapInArrow(_toxic_forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    seen = {r.form: r.n for r in seen.where(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "form").limit(20 * entries).collect()}
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(seen))
    other = sample.where("toxic = 0").select("text").mapInArrow(_counting(wanted), "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    other = dict(other.collect())
    odds = {f: float(np.log((n + 0.5) / (toxic + 1)) - np.log((other.get(f, 0) + 0.5) / (clean + 1))) for f, n in seen.items()}
    best = sorted((f for f in odds if odds[f] >= ODDS), key=lambda f: (-odds[f], -seen[f], f))[:entries]
    return {f: odds[f] for f in best}


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from labelled rows that aren't held out; None without both kinds of labels."""
    own = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    n = own.count()
    if not n:
        return None
    unit = 1 << 20
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(unit)) < min(unit, -(-unit * sample // n)))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")  # 16 bytes a row of the sample
    rows = written(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0).alias("level")), "labelled")
    weights = learnt_lexicon(rows.where("not level"))  # words that the calibration hasn't lent to the lexicon
    if not weights and not rows.where("toxic = 1").count():
        return None
    lexicon = rows.sparkSession.sparkContext.broadcast(Lexicon(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), lexicon.value)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("level"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "level", "x"])

    found = rows.mapInArrow(run, "toxic int, level boolean, x array<double>").toPandas()
    x, y, level = np.stack(found["x"].to_numpy()), found["toxic"].to_numpy(np.float64), found["level"].to_numpy(bool)
    if level.all() or not level.any():
        level = np.arange(len(y)) % 4 == 0
    order = np.lexsort((*x.T, y))  # the order of rows depends on the tasks
    x, y, level = x[order], y[order], level[order]
    trees = Trees().fit(x[~level], y[~level])
    return Model(weights, trees, isotonic(trees.margin(x[level]), y[level]))


def scored(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents with held_out, score and predicted; one row for each.

    A null text is empty; an empty text has the score of a text without any feature. A null doc_id counts as held out.
    Labels that are null, or neither 0 nor 1, are left aside; without labels of both kinds every score is 0. Rows that
    repeat a doc_id are scored each by its own text. Other columns pass through unless named as one of the new ones,
    which then replaces it."""
    found = fitted(documents, labels, sample)
    model = documents.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            score = own.score(batch.column("text")) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

    names = [c for c in documents.columns if c.lower() not in ("held_out", "score", "predicted")]
    df = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    out = df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")
    return out.select(*(F.col(f"`{c}`") for c in names), held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fold, score and prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).drop("text")
