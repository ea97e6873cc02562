"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are words and beginnings of words (3 to 7 letters) that labelled texts show to be toxic or clean beyond chance: the
`features` of the largest z-score of their document frequency in toxic against clean texts (at least `min_z`, in at least
`min_texts` texts). Every labelled text of the sample is read; near copies of one label share one vote, in these counts and in the fit. Cues are those in
`min_share` of the toxic texts at least, that have a toxic label in `min_precision` of their texts. A text's feature values are
log(1 + count) of each, and three of all its words with a cue: log(1 + count), presence, and number in a hundred words. Weights keep
the sign of their feature's z-score; the ridge penalty draws them to the common weights.
Grades: 0 clean; toxic labels are graded 1 to `grades` - 1 by the share of cue words in
the text, cut at quantiles; so a toxic label without any cue stays at grade 1. The model is P(grade <= g) =
logistic(t_g - w.x) with thresholds t_0 < t_1 < ... that share the weights w (ridge-penalised maximum likelihood); it
gives the expected severity, the sum over g of P(grade > g).

The fit reads at most about `sample` labelled rows (chosen by hash, whole texts); word counts are summed on executors and at
most `features` of them and the sample's sparse values reach the driver. Null text scores as empty text. Labels that are
null are not learned; with labels of one kind only, everything scores 0. Repeated rows count each. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, files_for, map_texts, row_files

_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


#: Lengths of word beginnings.
STEMS = range(3, 8)
_KEPT = 300_000


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Lookup(dict):
    """word -> (columns of its features, whether one is a cue), or None; remembers the words it has met."""

    def __init__(self, vocabulary: dict[str, int], cue: np.ndarray):
        super().__init__()
        self.vocabulary, self.cue = vocabulary, cue

    def __missing__(self, word: str) -> tuple[list[int], bool] | None:
        if len(self) > _KEPT:
            self.clear()
        at = [self.vocabulary[f] for f in features_of(word) if f in self.vocabulary]
        self[word] = found = (at, bool(self.cue[at].any())) if at else None
        return found

    def counts(self, text: str | None) -> tuple[Counter, int, int]:
        """(number of each feature column, number of words with a cue, number of words)."""
        all_ = words(text)
        hits = [h for h in map(self.__getitem__, all_) if h]
        return Counter(i for at, _ in hits for i in at), sum(c for _, c in hits), len(all_)

    def __reduce__(self):
        return Lookup, (self.vocabulary, self.cue)


def _same_text(text):
    """A key that near copies mostly share and other texts don't: the smallest of three hashes over all three words in a row (fewer words: the
    hash of the text). Texts that share a part p of these shingles share the key with a chance of about p^3."""
    w = F.array(F.split(text, "\\s+"))
    n = lambda x: F.greatest(F.size(x) - 2, F.lit(0))
    part = lambda x, k: F.slice(x, F.lit(k), n(x))
    rows = F.transform(w, lambda x: F.zip_with(F.zip_with(part(x, 1), part(x, 2), lambda a, b: F.xxhash64(a, b)), part(x, 3), lambda a, b: F.xxhash64(a, b)))
    least = F.transform(rows, lambda r: F.xxhash64(*[F.array_min(F.transform(r, (lambda k: lambda h: F.xxhash64(F.lit(k), h))(k))) for k in range(3)]))[0]
    return F.when(F.size(rows[0]) > 0, least).otherwise(F.xxhash64(text))


#: A text's vote is this divided by the number of labelled near copies that it has, itself included.
VOTE = 1_000_000


#: Number of features of all cue words together.
COMMON = 3


def common_features(cues: int, n_words: int) -> np.ndarray:
    return np.array([np.log1p(cues), float(cues > 0), min(100 * cues / max(n_words, 1), 10.0)])


class Severity:
    """vocabulary: word -> column; cue: whether a column's word is a cue; weights (the last: of all cue words); ascending thresholds."""

    def __init__(self, vocabulary: dict[str, int], cue: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.cue, self.weights, self.thresholds = vocabulary, cue, weights, thresholds
        self.lookup = Lookup(vocabulary, cue)

    def expected(self, text: str | None) -> float:
        """Expected grade; 0 if nothing was learned."""
        if not len(self.thresholds):
            return 0.0
        counts, cues, n = self.lookup.counts(text)
        score = sum(self.weights[i] * np.log1p(c) for i, c in counts.items()) + self.weights[-COMMON:] @ common_features(cues, n)
        return float((1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))).sum())


def fit_ordinal(
    x: np.ndarray, y: np.ndarray, levels: int, ridge: np.ndarray, sign: np.ndarray, rounds: int = 600, vote: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by projected gradient ascent (Adam) on the penalised likelihood.
    ridge: penalty of each weight; sign: 1 or -1, the side of 0 on which the weight stays; vote: weight of each row (1, if None)."""
    m, vote = x.shape[1], np.ones(len(x)) if vote is None else vote
    n = vote.sum()
    above = np.array([max(vote @ (y > g) / n, 0.5 / n) for g in range(levels - 1)])
    start = -np.log(above / (1 - np.minimum(above, 1 - 0.5 / n)))
    steps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(m), start[:1], steps])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    low, high = np.maximum(y - 1, 0), np.minimum(y, levels - 2)
    for k in range(1, rounds + 1):
        w, t = theta[:m], theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1 :]))])
        s = x @ w
        f_hi = np.where(y == levels - 1, 1.0, 1 / (1 + np.exp(np.clip(s - t[high], -60, 60))))
        f_lo = np.where(y == 0, 0.0, 1 / (1 + np.exp(np.clip(s - t[low], -60, 60))))
        p = np.maximum(f_hi - f_lo, 1e-12) / vote
        d_hi = np.where(y == levels - 1, 0.0, f_hi * (1 - f_hi)) / p
        d_lo = np.where(y == 0, 0.0, f_lo * (1 - f_lo)) / p
        g_t = np.bincount(high, d_hi, levels - 1) - np.bincount(low, d_lo, levels - 1)
        g_steps = np.array([g_t[j + 1 :].sum() for j in range(levels - 2)]) * np.exp(theta[m + 1 :])
        grad = np.concatenate([x.T @ (d_lo - d_hi) - ridge * w, [g_t.sum()], g_steps]) / n
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta + 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        theta[:m] = np.where(theta[:m] * sign > 0, theta[:m], 0)
    return theta[:m], theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1 :]))])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 20_000,
    features: int = 1024,
    min_z: float = 5.0,
    min_texts: int = 5,
    min_share: float = 0.02,
    min_precision: float = 0.7,
    grades: int = 4,
) -> Severity:
    """docs: texts; labels: (id, 0/1)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n_known = known.count()
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity sample"), "label_id"), 11).cast("double") / float(1 << 53)
    chosen = durable(known.where(chance < min(1.0, sample / max(n_known, 1))), 8)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most about `sample` rows of two numbers: small enough for every executor
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = durable(rows.withColumn("same", _same_text(F.coalesce("text", F.lit("")))).repartition(row_files(sample)))
    sizes = rows.groupBy("same", "toxic").agg(F.count(F.lit(1)).alias("copies"))
    vote = F.expr(f"{VOTE}L div copies")
    rows = rows.join(sizes, ["same", "toxic"]).select("id", "text", "toxic", "same", vote.alias("vote"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, vote in zip(*(batch.column(c) for c in ("text", "toxic", "vote")), strict=True):
                side, weight = toxic.as_py(), vote.as_py()
                for w in {"", *(f for w in set(words(text.as_py())) for f in features_of(w))}:
                    seen.setdefault(w, [0, 0])[side] += weight
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen)), pa.array([v[0] for v in seen.values()]), pa.array([v[1] for v in seen.values()])], names=["word", "clean", "toxic"]
            )

    counts = durable(map_texts(rows, count, "word string, clean long, toxic long").groupBy("word").agg(*[(F.sum(c) / VOTE).alias(c) for c in ("clean", "toxic")]), files_for(sample * 100))
    base = counts.where("word = ''").first()
    if base is None or not base.clean or not base.toxic:
        return Severity({}, np.empty(0, bool), np.zeros(COMMON), np.empty(0))
    p, q = F.col("toxic") / base.toxic, F.col("clean") / base.clean
    pooled = (F.col("toxic") + F.col("clean")) / (base.toxic + base.clean)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / base.toxic + 1 / base.clean))
    top = counts.where("word <> ''").where(F.col("clean") + F.col("toxic") >= min_texts).withColumn("z", z).where(F.abs("z") >= min_z).orderBy(F.desc(F.abs("z")), "word").limit(features).collect()
    vocabulary, cue = {r.word: i for i, r in enumerate(top)}, np.array([r.z > 0 and r.toxic >= max(min_share * base.toxic, min_precision * (r.toxic + r.clean)) for r in top], bool)

    lookup = Lookup(vocabulary, cue)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lookup.counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([list(f) for f, _, _ in found], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for f, _, _ in found], pa.list_(pa.int32())),
                    pa.array([c for _, c, _ in found], pa.int64()),
                    pa.array([n for _, _, n in found], pa.int64()),
                    batch.column("toxic"),
                    batch.column("vote"),
                    batch.column("same"),
                ],
                names=["at", "n", "cues", "words", "toxic", "vote", "same"],
            )

    data = map_texts(rows, encode, "at array<int>, n array<int>, cues long, words long, toxic int, vote long, same long").toArrow().to_pylist()
    data.sort(key=lambda r: (r["same"], r["toxic"], r["cues"], r["words"], sorted(zip(r["at"], r["n"], strict=True))))  # one order, whatever the tasks'
    x, y, share = np.zeros((len(data), len(top) + COMMON)), np.zeros(len(data), np.int64), np.zeros(len(data))
    vote = np.array([r["vote"] for r in data]) / VOTE
    for i, r in enumerate(data):
        x[i, r["at"]] = np.log1p(r["n"])
        y[i] = r["toxic"] > 0
        x[i, -COMMON:], share[i] = common_features(r["cues"], r["words"]), r["cues"] / max(r["words"], 1)
    cued = share[(y > 0) & (share > 0)]
    for cut in np.unique(np.quantile(cued, np.arange(1, grades - 1) / (grades - 1))) if len(cued) else ():
        y += (y > 0) & (share > cut)
    present = np.unique(y)
    y = np.searchsorted(present, y)  # grades without rows are left out
    ridge, sign = np.append(np.full(len(top), 5.0), np.full(COMMON, 0.1)), np.append([1.0 if r.z > 0 else -1.0 for r in top], np.ones(COMMON))
    return Severity(vocabulary, cue, *fit_ordinal(x, y, len(present), ridge, sign, vote=vote))


def score(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """(id, severity, toxic) for each row: toxic if the expected severity is at least `reject_at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.expected(t.as_py()) for t in batch.column(1)], pa.float64())], names=["id", "severity"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, severity double")
    return scored.select(F.col("id").alias(id_col), "severity", (F.col("severity") >= reject_at).alias("toxic"))


def keep_clean(docs: DataFrame, model: Severity, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The rows of docs below `reject_at`, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.expected(t.as_py()) < reject_at for t in batch.column(at)], pa.bool_()))

    return map_texts(docs, run, docs.schema)
