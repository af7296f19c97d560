"""Quality classifier from positive and unlabelled texts.

Trusted positives and unlabelled web text, each a bounded sample of the training rows (SAMPLE, taken by hash order),
give a linear model over binned text measurements that minimises the non-negative unbiased risk
pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]) with the sigmoid loss. The class prior pi is estimated from the positives
and the unlabelled texts alone (`prior` overrides it): whatever texts a region of scores holds, the share of the unlabelled there
is at least pi times that of the positives, so the least ratio over the regions above a score, on halves that the scoring
model has not seen, is taken for pi (`estimated_prior`). Labels say which texts are positives; negatives are never
used. Fitting runs on the driver, over samples of fixed
size; scoring is one pass over whole texts without a shuffle. Labels come only from rows whose crc32(doc_id as text)
mod 3 is not 1; doc_id, lang and source are no inputs of a score.

Defined results: null, empty and blank texts get a score as any other. A null doc_id is never used in training. Equal
texts have equal scores, repeated rows too; of a doc_id with several texts all count in training. Without any positive training row, every score is the prior 0.5 (predicted 1). An empty table
gives no rows; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import small_arrow_batches
from .spotsigs import _ANCHORS

SAMPLE, BINS, STEPS, RATE = 6000, 12, 600, 0.05
FEATURES = ("words", "word_length", "symbols", "digits", "capitals", "exclaims", "bars", "other_marks", "distinct_words", "distinct_pairs", "common_words", "lines", "spaces", "long_words", "one_letter", "top_word")

_CLASS = {name: np.zeros(256, bool) for name in ("symbols", "digits", "capitals", "exclaims", "bars", "other_marks", "small")}
for _name, _chars in (("symbols", b"#*$%&<>^~=+@\\{}[]"), ("digits", b"0123456789"), ("capitals", bytes(range(65, 91))), ("exclaims", b"!?"), ("bars", b"|_"), ("other_marks", b".,;:'\"()-"), ("small", bytes(range(97, 123)))):
    _CLASS[_name][list(_chars)] = True


def measure(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = T.Words(column)
    n = np.maximum(w.count, 1).astype(float)
    size = np.maximum(np.diff(w.offsets) - 1, 1).astype(float)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])  # noqa: E731  bytes of a class in each row
    kind = {k: per(table[w.data]).astype(float) for k, table in _CLASS.items()}
    of = lambda mask: np.bincount(w.doc[mask], minlength=w.rows).astype(float)
    length = w.end - w.start
    x = w.hashes()
    lower = T.Words(column, lower=True).hashes()
    place = np.searchsorted(_ANCHORS, lower)
    common = _ANCHORS[np.minimum(place, len(_ANCHORS) - 1)] == lower

    def counts(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each row, and how often the most frequent occurs."""
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        top = np.zeros(w.rows)
        np.maximum.at(top, doc[start], np.diff(np.concatenate([start, [len(h)]])).astype(float))
        return np.bincount(doc[start], minlength=w.rows).astype(float), top

    distinct, top = counts(x, w.doc)
    pair, at = T.grams(w, x, 2)
    pairs, _ = counts(pair, w.doc[at])
    out = {
        "words": np.log1p(w.count),
        "word_length": np.bincount(w.doc, length, minlength=w.rows) / n,
        "distinct_words": distinct / np.maximum(n, 1) ** 0.8,
        "distinct_pairs": np.where(w.count > 1, pairs / np.maximum(w.count - 1, 1), 1.0),
        "common_words": of(common) / n,
        "lines": per(w.data == 10) / n,
        "spaces": 1 - np.bincount(w.doc, length, minlength=w.rows) / size,
        "long_words": of(length > 20) / n,
        "one_letter": of(length == 1) / n,
        "top_word": top / n,
    }
    out |= {k: kind[k] / size for k in ("symbols", "digits", "exclaims", "bars", "other_marks")}
    out["capitals"] = kind["capitals"] / np.maximum(kind["capitals"] + kind["small"], 1)
    return np.stack([out[k] for k in FEATURES], 1)


class Model:
    """Bins by quantiles of the unlabelled sample; weights of each bin; the sum is the decision value."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.full(len(x), self.bias)
        for j, e in enumerate(self.edges):
            g += self.weights[j, np.searchsorted(e, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk by full-batch Adam with a small ridge; no randomness."""
    k = positive.shape[1]
    edges = []
    for j in range(k):
        q = np.quantile(unlabelled[:, j], np.concatenate([np.linspace(0, 1, BINS + 1)[1:-1], [0.02, 0.05, 0.95, 0.98]]))
        edges.append(np.unique(q))
    width = max(len(e) for e in edges) + 1
    place = lambda x: np.stack([np.searchsorted(e, x[:, j], "right") + j * width for j, e in enumerate(edges)], 1)
    ip, iu = place(positive), place(unlabelled)
    w = np.zeros(k * width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def pull(index: np.ndarray, slope: np.ndarray) -> np.ndarray:
        grad = np.bincount(index.ravel(), np.repeat(slope, k), minlength=k * width + 1)
        grad[-1] = slope.sum()
        return grad

    for step in range(1, STEPS + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(w[i].sum(1) + w[-1], -40, 40))) for i in (ip, iu))
        # loss of label y is sigmoid(-y g): its slope is -y s (1 - s)
        dp, du = sp * (1 - sp) / len(ip), su * (1 - su) / len(iu)
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            grad = pull(ip, -prior * dp) + pull(iu, du) + pull(ip, -prior * dp)
        else:  # the estimate of the negative part has become negative: step back along it
            grad = -(pull(iu, du) + pull(ip, -prior * dp))
        grad[:-1] += 1e-4 * w[:-1] / k
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(edges, w[:-1].reshape(k, width), float(w[-1]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.01, doubt: float = 0.1, rounds: int = 5) -> float:
    """The share of positives among the unlabelled texts: for every second text, by a model of the others, the least ratio of
    unlabelled to positive texts scored at a threshold or above; the mean of the two.

    Of the thresholds that one counts for which the ratio plus its sampling error, at confidence 1 - `doubt`, is least. The models,
    which only rank, are fitted with prior 1/2 first, and then with what the round before has found."""
    halves = [(positive[h::2], unlabelled[h::2], positive[1 - h :: 2], unlabelled[1 - h :: 2]) for h in (0, 1)]
    halves = [h for h in halves if all(map(len, h))]
    if not halves:
        return 0.5
    prior = 0.5
    for _ in range(rounds):
        found = []
        for p, u, other_p, other_u in halves:
            model = fit(other_p, other_u, prior)
            sp, su = np.sort(model.score(p)), np.sort(model.score(u))
            at = np.unique(sp)
            above_p, above_u = (1 - np.searchsorted(s, at) / len(s) for s in (sp, su))
            error = sum(np.sqrt(np.log(4 / doubt) / (2 * n)) for n in (len(p), len(u)))
            best = int(np.argmin((above_u + (1 + slack) * error) / above_p))
            found.append(above_u[best] / above_p[best])
        prior = float(min(1.0, np.mean(found)))
    return prior


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float | None = None) -> Model | None:
    """A model from at most `sample` positives and as many unlabelled rows, the first by a hash of doc_id."""
    usable = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    first = lambda df, seed: df.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "doc_id").limit(sample)
    ids = first(usable(labels).where("quality = 1"), 1).withColumn("positive", F.lit(True)).union(first(usable(docs), 2).withColumn("positive", F.lit(False)))
    kinds = ids.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or("positive").alias("p"), F.bool_or(~F.col("positive")).alias("u"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(kinds), F.col("doc_id") == F.col("id")).select("p", "u", "text")

    def run(batches):
        for batch in batches:
            for lo, hi in T.chunks(batch.column("text")):
                x = measure(batch.column("text")[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column("p")[lo:hi], batch.column("u")[lo:hi], pa.array(list(x), pa.list_(pa.float64()))], names=["p", "u", "x"])

    found = rows.mapInArrow(run, "p boolean, u boolean, x array<double>").toArrow()
    if not found.num_rows:
        return None
    x = np.array(found.column("x").to_pylist())
    order = np.lexsort(x.T[::-1])  # whatever order the rows came in
    x, p, u = x[order], found.column("p").to_numpy()[order], found.column("u").to_numpy()[order]
    if not p.any() or not u.any():
        return None
    return fit(x[p], x[u], prior if prior is not None else estimated_prior(x[p], x[u]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float | None = None, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """Every column of `docs`, with held_out, score and predicted added under these names (a column of that name is replaced)."""
    small_arrow_batches(docs.sparkSession)
    model = train(docs, labels, sample, prior)
    if model is None:
        value = F.lit(0.5)
    else:

        @F.arrow_udf("double")
        def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for text in texts:
                parts = [model.score(measure(text[lo:hi])) for lo, hi in T.chunks(text)]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
            T.give_back()

        value = score(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.withColumn(names[1], value)
    return out.withColumn(names[0], held_out(F.col("doc_id"))).withColumn(names[2], (F.col(names[1]) >= 0.5).cast("int"))
