"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon, how near its words stand to the second person,
capitals, punctuation, and how often words of the lexicon are disguised. To the fixed lexicon come
stems (starts of words, and whole words) that the labelled sample shows to mark toxic texts, all that pass
the thresholds. The isotonic calibration sees each row only through trees and stems of the other folds. The
trees are fitted on the driver, to which only features and those stems come.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, cut, drop, residue, texts_of
from .labelled import training_rows

#: Labelled rows that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
FOLD, HELD_OUT, THRESHOLD = 4, 2, 0.3
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 64, 12

#: The lexicon, insults of persons and words of contempt, in the languages of the corpus.
INSULTS = "idiot idiots moron morons loser losers clown clowns fool fools jerk jerks imbecile imbeciles dumbass asshole bastard bitch coward cretin degenerate dimwit freak liar maggot parasite pig psycho rat retard scumbag scum swine trash vermin weirdo wimp blockhead bonehead buffoon dunce halfwit nitwit nutcase simpleton idiota idiotas imbécil estúpido estúpida tonto payaso basura cabrón pendejo trottel dummkopf arschloch depp vollidiot abschaum versager connard imbécile abruti crétin salaud ordure minable"
CONTEMPT = "stupid pathetic worthless disgusting dumb ugly useless filthy hateful horrible repulsive revolting ridiculous shameful vile gross lame crap damn shit fuck fucking hell sucks hate die kill despicable contemptible loathsome asqueroso patético inútil repugnante dumm erbärmlich wertlos ekelhaft widerlich stupide pathétique dégoûtant nul"
SECOND = "you your yours yourself u ur du dich dir dein deine deinen euch tu tú te ti tus usted toi ton ta tes vous votre vos"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LEET = bytes.maketrans(b"013457@$", b"oieastas")
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_ALNUM_SPACE = bytes([*range(48, 58), *_LETTERS, 9, 10, 11, 12, 13, 32, *range(128, 256)])
_MIXED = re.compile(rb"[A-Za-z][0-9@$*]+[A-Za-z]")
_RUNS = re.compile(rb"[!?.*#$%&]{2,}")
_LONG = re.compile(rb"([a-z])\1{2,}")
_SETS = [frozenset(x.encode() for x in s.split()) for s in (INSULTS, CONTEMPT, SECOND)]
FEATURES = 25
#: How many of a row's features don't depend on the learned stems; they come first.
FIXED = 20
#: Bytes of a learned stem; toxic texts that must hold one; least logarithm of the ratio of its rates in toxic and other texts.
STEM_BYTES, STEM_TEXTS, STEM_ODDS = (4, 5, 6, 7, 8), 4, 2.0
#: Folds of the calibration, and the counts of a stem by fold and label.
FOLDS = 3
CELLS = [f"n{k}{label}" for k in range(FOLDS) for label in (0, 1)]


def stems_of(words: set[bytes]) -> set[bytes]:
    """The starts of the words and, marked by $, the words themselves."""
    found = {w[:k] for k in STEM_BYTES for w in words if len(w) >= k}
    found.update(w + b"$" for w in words)
    return found


def choose_stems(stems: list[bytes], toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> dict[bytes, float]:
    """Stems that pass the thresholds, with their logarithm of the ratio of rates."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return {stems[i]: float(odds[i]) for i in np.flatnonzero((toxic >= STEM_TEXTS) & (odds >= STEM_ODDS))}


def stem_features(distinct: set[bytes], stems: dict[bytes, float]) -> list[float]:
    marks = []
    if stems and not stems_of(distinct).isdisjoint(stems):
        marks = [max(stems[k] for k in own) for w in distinct if (own := stems_of({w}) & stems.keys())]
    return [float(len(marks)), max(marks, default=0.0), float(sum(marks)), len(marks) / max(1, len(distinct)) * 100, float(sum(m > 3 for m in marks))]


def features(text: bytes, *lexicons: dict[bytes, float]) -> list[float]:
    """The fixed features, then those of each of the learned lexicons."""
    words = text.translate(_FOLD).split()
    n, size = len(words), max(1, len(text))
    distinct = set(words)
    insults, contempt, second = _SETS
    found = (insults | contempt).intersection(words)
    persons = second.intersection(words)
    hits = [i for i, w in enumerate(words) if w in found] if found else []
    yous = [i for i, w in enumerate(words) if w in persons] if persons else []
    rude = sum(words[i] in insults for i in hits)
    near = 0.0
    if hits and yous:
        at = np.array(yous)
        k = np.searchsorted(at, hits)
        gaps = np.minimum(np.abs(at[np.minimum(k, at.size - 1)] - hits), np.abs(at[np.maximum(k - 1, 0)] - hits))
        near = 1.0 / float(gaps.min())
    plain = text.lower()
    disguised = stretched = 0
    if mixed := len(_MIXED.findall(text)):
        disguised = sum(w in insults or w in contempt for w in plain.translate(_LEET).translate(_FOLD).split()) - len(hits)
    if _LONG.search(plain):
        stretched = sum(w in insults or w in contempt for w in _LONG.sub(rb"\1", plain).translate(_FOLD).split()) - len(hits)
    letters = len(text) - len(text.translate(None, _LETTERS))
    upper = len(text) - len(text.translate(None, _UPPER))
    marks = len(text.translate(None, _ALNUM_SPACE))
    runs = len(_RUNS.findall(text))
    per = 100.0 / max(1, n)
    row = [
        len(hits) * per, rude * per, (len(hits) - rude) * per, float(len(found)), np.log1p(len(hits)), np.log1p(rude), near, len(yous) * per,
        upper / max(1, letters), text.count(b"!") / size * 100, text.count(b"?") / size * 100, marks / size * 100, runs * per,
        mixed * per, max(0, disguised) * per, float(max(0, disguised)), max(0, stretched) * per, np.log1p(n), np.log1p(len(text)), letters / size,
    ]
    return [float(x) for x in row] + [x for stems in lexicons for x in stem_features(distinct, stems)]


def _tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int):
    """A tree over binned features as (feature, bin, left, right) or a leaf's value; a row goes left where its bin is not above."""
    total_g, total_h = g.sum(), h.sum()
    leaf = -total_g / (total_h + 1.0)
    if depth == 0 or g.size < 2 * least:
        return float(leaf)
    best, gain = None, 1e-3
    for f in range(bins.shape[1]):
        b = bins[:, f]
        gl = np.cumsum(np.bincount(b, g, BINS + 1))[:-1]
        hl = np.cumsum(np.bincount(b, h, BINS + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
        score = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
        score[(nl < least) | (g.size - nl < least)] = 0
        k = int(np.argmax(score))
        if score[k] > gain:
            best, gain = (f, k), float(score[k])
    if best is None:
        return float(leaf)
    left = bins[:, best[0]] <= best[1]
    return (*best, _tree(bins[left], g[left], h[left], depth - 1, least), _tree(bins[~left], g[~left], h[~left], depth - 1, least))


def _apply(tree, bins: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    if not isinstance(tree, tuple):
        out[rows] += RATE * tree
        return
    left = bins[rows, tree[0]] <= tree[1]
    _apply(tree[2], bins, out, rows[left])
    _apply(tree[3], bins, out, rows[~left])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ends of the pools and their means, one row of each class added to every pool's neighbourhood."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    mean = float(np.mean(y))
    return np.array([p[0] for p in pools]), np.array([(p[1] + mean) / (p[2] + 1.0) for p in pools])


class Boosted:
    """Logistic loss, histogram splits, isotonic calibration on predictions for rows of folds that neither trees nor stems have seen. With no rows or a single class the score is the mean label, or 0.5; with few rows a leaf may be as small as an eighth of them.

    apart: for each fold the rows' features under the stems of the other folds; x under all stems.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, stems: dict[bytes, float] | None = None, fold: np.ndarray | None = None, apart: list[np.ndarray] | None = None):
        self.stems = stems or {}
        self.mean = float(y.mean()) if y.size else 0.5
        self.trees = []
        self.leaf = max(1, min(LEAF, y.size // 8))
        if y.size == 0 or y.min() == y.max():
            return
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
        fold = np.arange(y.size) % FOLDS if fold is None else fold
        unseen = np.zeros(y.size)
        for k in range(FOLDS):
            bins = self.binned(x if apart is None else apart[k])
            unseen[fold == k] = self._raw(self._fit(bins[fold != k], y[fold != k]), bins[fold == k])
        self.ends, self.values = isotonic(unseen, y)
        self.trees = self._fit(self.binned(x), y)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)

    def _fit(self, bins: np.ndarray, y: np.ndarray) -> list:
        mean = y.mean()
        raw = np.full(y.size, np.log(mean / (1 - mean)) if 0 < mean < 1 else 0.0)
        trees = [(raw[0] if raw.size else 0.0)]
        rows = np.arange(y.size)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = _tree(bins, p - y, p * (1 - p), DEPTH, self.leaf)
            _apply(tree, bins, raw, rows)
            trees.append(tree)
        return trees

    def _raw(self, trees: list, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[0], trees[0])
        for t in trees[1:]:
            _apply(t, bins, out, np.arange(bins.shape[0]))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(x.shape[0], self.mean)
        raw = self._raw(self.trees, self.binned(x))
        pool = np.minimum(np.searchsorted(self.ends, raw, "left"), self.ends.size - 1)
        # a thousandth of the uncalibrated probability keeps the order inside a pool
        return np.clip(0.999 * self.values[pool] + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Boosted:
    """Trees for labels(doc_id, toxic); rows bounds the sample and so what the driver gathers: the stems that pass the thresholds in it, and some FEATURES numbers a row."""
    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(FOLDS)).cast("int")
    sample = cut(training_rows(docs, labels, "toxic", FOLD, HELD_OUT, rows).select("doc_id", (F.col("label") > 0).cast("int").alias("label"), "text", fold.alias("fold")), "sample")

    def count():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[bytes, np.ndarray] = {}
            for t, label, k in zip(texts_of(b.column("text")), b.column("label").to_pylist(), b.column("fold").to_pylist()):
                for s in stems_of(set(t.translate(_FOLD).split())):
                    if (own := found.get(s)) is None:
                        own = found[s] = [0] * (2 * FOLDS)
                    own[2 * k + label] += 1
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in range(2 * FOLDS))], ["stem", *CELLS])

        return run

    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "label").count().collect():
        sizes[r.fold, r.label] = r["count"]
    counted = by_batch(sample, count, ", ".join(["stem binary", *(f"{c} long" for c in CELLS)])).groupBy("stem").agg(*[F.sum(c).alias(c) for c in CELLS])
    # a stem that passes without a fold has as many toxic texts in all
    toxic = sum((F.col(c) for c in CELLS[3::2]), F.col(CELLS[1]))
    got = counted.filter(toxic >= STEM_TEXTS).filter(_passes(sizes)).toArrow().sort_by("stem")
    stems, counts = got["stem"].to_pylist(), np.stack([got[c].to_numpy() for c in CELLS], axis=1).reshape(-1, FOLDS, 2)
    lexicons = []
    for left_out in (None, *range(FOLDS)):
        use = [k for k in range(FOLDS) if k != left_out]
        other, mine = counts[:, use].sum(1).T.astype(float)
        lexicons.append(choose_stems(stems, mine, other, *sizes[use].sum(0)[::-1].astype(int)))
    shipped = docs.sparkSession.sparkContext.broadcast(lexicons)

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x = pa.array([features(t, *shipped.value) for t in texts_of(b.column("text"))], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([b.column("label"), b.column("fold"), x], ["label", "fold", "x"])

        return run

    got = by_batch(sample, make, "label int, fold int, x array<double>").toArrow()
    drop(sample)
    x = np.array(got["x"].to_pylist(), float).reshape(-1, FIXED + (FEATURES - FIXED) * len(lexicons))
    # one order, whatever the tasks'
    order = np.lexsort(x.T) if x.size else np.zeros(0, np.int64)
    x, y, folds = x[order], got["label"].to_numpy().astype(float)[order], got["fold"].to_numpy()[order]
    own = FEATURES - FIXED
    views = [np.concatenate([x[:, :FIXED], x[:, FIXED + k * own : FIXED + (k + 1) * own]], axis=1) for k in range(len(lexicons))]
    return Boosted(views[0], y, lexicons[0], folds, views[1:])


def _passes(sizes: np.ndarray):
    """Whether a stem's odds pass the threshold over all folds, or over all but one."""
    ok = F.lit(False)
    for left_out in (None, *range(FOLDS)):
        use = [k for k in range(FOLDS) if k != left_out]
        n_other, n_toxic = sizes[use].sum(0)
        other, toxic = (sum((F.col(CELLS[2 * k + i]) for k in use[1:]), F.col(CELLS[2 * use[0] + i])) for i in (0, 1))
        ok = ok | (F.log((toxic + 0.5) / float(n_toxic + 1)) - F.log((other + 0.5) / float(n_other + 1)) >= STEM_ODDS - 1e-9)
    return ok


def score_toxicity(docs: DataFrame, model: Boosted) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs. A null text is an empty one and has a score too; a null id counts as the empty text in the fold; rows that repeat come back as often; other columns are not looked at."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            s = model.score(np.array([features(t, model.stems) for t in texts_of(b.column("text"))], float).reshape(-1, FEATURES))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

        return run

    kind = dict(docs.dtypes)["doc_id"]
    scored = by_batch(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double")
    return scored.select("doc_id", (residue(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """score_toxicity by trees fitted on at most rows of the labels outside the held-out fold. Without labels of both classes every score is the mean label, or 0.5 without any; texts of any length are scored whole; empty tables give empty tables; ties in the trees go to the first feature."""
    return score_toxicity(docs, fit(docs, labels, rows))
