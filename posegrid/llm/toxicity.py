"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a seed lexicon of insults and of terms learned from the labels
(words and word beginnings far more frequent in toxic texts), their nearness to second-person
words, and rates of capitals, punctuation and obfuscated words (digits or signs within a word,
letters drawn out). Terms are counted by Spark over the sample; trees and calibration are fitted
on the sample's feature rows, of which there are at most `sample_rows`. Terms for a training row
are learned from the other half of the sample, so that its features look like those of new texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm.bpe import _field, _with
from posegrid.llm.labelled import labelled_sample
from posegrid.session import ship

SAMPLE_ROWS, TERMS = 20_000, 3_000
#: Common insults in four languages; terms learned from the labels come on top.
SEED = frozenset(
    """idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown clowns
    fool fools jerk creep freak imbecile retard bastard bitch asshole shit shitty crap fuck fucking fucker hate kill vermin filth filthy
    ugly useless liar coward pig swine dog rat parasite subhuman savage dumm dummkopf trottel depp blödmann arschloch scheiße scheisse
    mistkerl hurensohn abschaum versager wertlos ekelhaft widerlich con connard connasse salaud salope merde ordure crétin abruti
    débile raclure minable dégueulasse tonto tonta estúpido estúpida imbécil cabrón gilipollas mierda puta puto basura escoria
    asqueroso inútil payaso perdedor""".split()
)
YOU = frozenset("you your yours youre yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre usted ustedes tú ti tus".split())
NAMES = ["seed_rate", "seed_hits", "term_rate", "term_hits", "term_best", "you_near", "you_rate", "capitals", "exclaims", "punctuation", "obfuscated", "unmasked", "words"]
_TOKEN = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[^\W\d_][0-9@$*|!]+[^\W\d_]\S*")
_LEET = str.maketrans("013457@$!|", "oieastasii")
_DRAWN = re.compile(r"(.)\1{2,}")


def terms_of(text: str) -> set[str]:
    """Distinct lower-case words and, marked by a star, their beginnings of 4 and 5 letters."""
    words = set(_TOKEN.findall(text.lower()))
    return words | {w[:5] + "*" for w in words if len(w) > 5} | {w[:4] + "*" for w in words if len(w) > 4}


def features(text: str, terms: dict[str, float]) -> list[float]:
    low = text.lower()
    tokens = _TOKEN.findall(low)
    n, chars = max(len(tokens), 1), max(len(text), 1)
    own = set(tokens)
    weight: dict[str, float] = {}
    for w in own:
        best = max(terms.get(w, 0.0), terms.get(w[:5] + "*", 0.0) if len(w) > 5 else 0.0, terms.get(w[:4] + "*", 0.0) if len(w) > 4 else 0.0)
        if best:
            weight[w] = best
    seeds = own & SEED
    seed_hits = term_hits = near = 0
    if seeds or weight:
        you = [i for i, t in enumerate(tokens) if t in YOU]
        at = np.array(you or [-100])
        for i, t in enumerate(tokens):
            seed_hits += t in seeds
            term_hits += t in weight
            if t in seeds or t in weight:
                near += bool(np.abs(at - i).min() <= 3)
    masked = _MASKED.findall(low) if any(c in low for c in "013457@$*|!") else []
    unmasked = 0
    for t in masked:
        plain = _DRAWN.sub(r"\1", t.translate(_LEET)).strip(".,;:!?\"'()")
        unmasked += plain in SEED or plain in terms
    drawn = sum(1 for t in own if _DRAWN.search(t)) if _DRAWN.search(low) else 0
    marks = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count("*") + text.count("#") + text.count("$")
    return [
        seed_hits / n, np.log1p(seed_hits), term_hits / n, np.log1p(term_hits), max(weight.values(), default=0.0), near / n,
        sum(t in own for t in YOU) / n, sum(map(str.isupper, text.split())) / n, text.count("!") / chars, marks / chars,
        (len(masked) + drawn) / n, unmasked, np.log1p(len(tokens)),
    ]


class Trees:
    """Boosted regression trees of a depth for logistic loss, on features cut at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for c in x.T]
        b = self._bins(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees, self.depth = float(np.log(p / (1 - p))), [], depth
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, split = np.zeros(len(y), np.int64), {}
            for level in range(depth):
                width = 1 << level
                gain = np.zeros(width)
                best = [(0, bins + 1)] * width
                for j in range(x.shape[1]):
                    key = node * (bins + 2) + b[:, j]
                    sg = np.bincount(key, g, width * (bins + 2)).reshape(width, -1).cumsum(1)
                    sh = np.bincount(key, h, width * (bins + 2)).reshape(width, -1).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    score = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                    score[(sh < 1e-2) | (th - sh < 1e-2)] = 0
                    k = score.argmax(1)
                    for i in range(width):
                        if score[i, k[i]] > gain[i] + 1e-9:
                            gain[i], best[i] = score[i, k[i]], (j, int(k[i]))
                split[level] = np.array(best)
                node = node * 2 + (b[np.arange(len(y)), split[level][node, 0]] > split[level][node, 1])
            leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            self.trees.append((split, leaf))
            f += leaf[node]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bins(x), np.full(len(x), self.start)
        for split, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = node * 2 + (b[np.arange(len(x)), split[level][node, 0]] > split[level][node, 1])
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y over x, by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # least x, greatest x, sum, count
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        if pools and pools[-1][1] == a:
            pools[-1][2] += b
            pools[-1][3] += 1
        else:
            pools.append([a, a, b, 1])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            top = pools.pop()
            pools[-1] = [pools[-1][0], top[1], pools[-1][2] + top[2], pools[-1][3] + top[3]]
    # half a case of each kind keeps the ends off 0 and 1
    at = np.array([v for a, b, _, _ in pools for v in (a, b)])
    fit = np.array([v for _, _, s, n in pools for v in ((s + 0.5) / (n + 1),) * 2])
    return at, np.maximum.accumulate(fit)


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, terms: dict[str, float]):
        self.terms, self.prior, self.trees = terms, (y.sum() + 1) / (len(y) + 2), None
        if 0 < y.sum() < len(y):
            fold, out = np.arange(len(y)) % 4, np.zeros(len(y))
            for k in range(4):
                rest = fold != k
                if 0 < y[rest].sum() < rest.sum():
                    out[~rest] = Trees(x[rest], y[rest]).margin(x[~rest])
            self.trees, self.knots = Trees(x, y), isotonic(out, y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.prior))
        x = np.array([features(t or "", self.terms) for t in texts], float).reshape(-1, len(NAMES))
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of toxic rows, with the rows that have them in each half of the sample."""
    for batch in batches:
        counts: Counter = Counter()
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half"))):
            if label:
                counts.update((t, half) for t in terms_of(text))
        if counts:
            yield pa.RecordBatch.from_pydict({"term": [k[0] for k in counts], "half": [k[1] for k in counts], "n": list(counts.values())})


def _terms(sample: DataFrame, size: list[list[int]], keep: int) -> list[dict[str, float]]:
    """Learned terms of half 0, half 1 and all: term to log odds. size[half][label]: rows."""
    spark = sample.sparkSession
    toxic = sample.mapInArrow(_count, "term string, half long, n long").groupBy("term").agg(F.sum(F.expr("IF(half = 0, n, 0)")).alias("n0"), F.sum(F.expr("IF(half = 1, n, 0)")).alias("n1"))
    least = max(3, (size[0][1] + size[1][1]) // 400)
    top = toxic.where(F.col("n0") + F.col("n1") >= least).orderBy(F.desc(F.col("n0") + F.col("n1")), "term").limit(20 * keep).collect()
    wanted = spark.sparkContext.broadcast({r.term for r in top})

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half"))):
                if not label:
                    counts.update((t, half) for t in terms_of(text) & wanted.value)
            if counts:
                yield pa.RecordBatch.from_pydict({"term": [k[0] for k in counts], "half": [k[1] for k in counts], "n": list(counts.values())})

    rest = {(r.term, r.half): r.n for r in sample.mapInArrow(clean, "term string, half long, n long").groupBy("term", "half").agg(F.sum("n").alias("n")).collect()}
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n1, n0 = sum(size[h][1] for h in halves), sum(size[h][0] for h in halves)
        found = {}
        for r in top:
            bad, good = sum((r.n0, r.n1)[h] for h in halves), sum(rest.get((r.term, h), 0) for h in halves)
            odds = (bad + 0.5) / (n1 + 1) / ((good + 0.5) / (n0 + 1))
            if bad >= max(2, least * len(halves) // 2) and odds >= 12:
                found[r.term] = float(np.log(odds))
        out.append(dict(sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))[:keep]))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> Model:
    """Fit on at most sample_rows labelled rows outside the held-out fifth. Equal texts count once.
    With no labelled rows, or rows of one class only, every score is the smoothed share of toxic rows."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col)
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "id").alias("text"), F.min_by("label", "id").alias("label")).withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    size = [[0, 0], [0, 0]]
    for r in sample.groupBy("half", (F.col("label") > 0).cast("int").alias("l")).count().collect():
        size[r.half][r.l] = r["count"]
    learned = _terms(sample.withColumn("label", (F.col("label") > 0).cast("int")), size, terms)
    both = docs.sparkSession.sparkContext.broadcast(learned)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, both.value[1 - h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "y": batch.column("label"), "x": pa.array(got, pa.list_(pa.float64()))})

    got = sorted(sample.mapInArrow(rows, "h long, y int, x array<double>").collect())
    x = np.array([r.x for r in got], float).reshape(-1, len(NAMES))
    return Model(x, np.array([float(r.y > 0) for r in got]), learned[2])


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows of docs with out_col, the calibrated probability that the whole text is toxic.
    Null texts are read as empty; a column called out_col is replaced; empty tables stay empty."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for a in range(0, table.num_rows, 1000):
                part = table.slice(a, 1000)
                yield from _with(part, out_col, pa.array(shared.value.score(part[text_col].to_pylist()))).combine_chunks().to_batches()

    return docs.mapInArrow(run, _field(docs, out_col, "double"))
