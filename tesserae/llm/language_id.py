"""Language identification by mixture inference.

Each language is a distribution over hashed character n-grams (1 to 3 characters), learned from labelled texts. For every
text, expectation-maximisation estimates the proportions of the languages from the n-gram likelihoods; the set of
languages is then chosen by penalised likelihood: the smallest share is dropped and the mixture refitted as long as the
loss in log-likelihood is below `penalty` * log(n-grams) for each language dropped.

Training reads at most about `per_lang` texts a language (chosen by hash, whole texts); the counts are summed on the
executors. More than 1000 languages are an error (the model is sent to all executors: 64 kB a language). Null text, and
text without a letter, is `und` with score 0; so is everything if nothing was learned. Labels that are null are not
learned. Repeated rows and ties are no special case: a text's result depends on that text alone; equal proportions go to
the language first by code point. An empty table gives an empty result. Very long texts are counted in pieces, whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SIZE = 1 << 13
_PIECE = 1 << 18
_CODE = re.compile(r"[0-9@]")


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a text in lower case, words parted by single spaces."""
    total = np.zeros(SIZE, np.int64)
    for at in range(0, len(text), _PIECE):
        norm = " " + " ".join(text[at : at + _PIECE].lower().split()) + " "
        c = np.frombuffer(norm.encode("utf-32-le", "replace"), np.uint32)
        c1 = c * np.uint32(0x9E3779B1)
        g2 = c1[:-1] * np.uint32(31) + c1[1:]
        g3 = g2[:-1] * np.uint32(0x85EBCA6B) + c1[2:]
        for g in (c1 ^ np.uint32(0x5BD1E995), g2, g3):
            h = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((h ^ (h >> np.uint32(13))) & np.uint32(SIZE - 1), minlength=SIZE)
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Mixture:
    """Languages in code point order with their n-gram log-likelihoods, and the inference for one text."""

    def __init__(self, counts: dict[str, np.ndarray], penalty: float = 2.0, rounds: int = 12):
        self.langs = sorted(counts)
        table = np.stack([counts[x] for x in self.langs], axis=1).astype(np.float64) if self.langs else np.zeros((SIZE, 0))
        pooled = table.sum(axis=1, keepdims=True) + 0.5
        pooled /= pooled.sum()
        self.p = ((table + 50 * pooled) / (table.sum(axis=0, keepdims=True) + 50)).astype(np.float32)
        self.penalty, self.rounds = penalty, rounds

    def _fit(self, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
        k, total = p.shape[1], float(n.sum())
        if k == 1:
            return np.ones(1), float(n @ np.log(p[:, 0]))
        share = np.full(k, 1 / k, np.float32)
        for _ in range(self.rounds):
            share = share * ((n / (p @ share)) @ p) / total
        return share, float(n @ np.log(p @ share + 1e-30))

    def infer(self, text: str) -> tuple[list[int], np.ndarray]:
        """The chosen languages (by index) and their proportions."""
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        n, chosen = counts[at].astype(np.float32), list(range(len(self.langs)))
        p, price = self.p[at], self.penalty * math.log(max(float(n.sum()), 2.0))
        share, fit = self._fit(n, p)
        while len(chosen) > 1:
            rest = np.delete(np.arange(len(chosen)), int(np.argmin(share)))
            less, worse = self._fit(n, p[:, [chosen[i] for i in rest]])
            if fit - worse > price:
                break
            chosen, share, fit = [chosen[i] for i in rest], less, worse
        return chosen, share

    def predict(self, text: str | None) -> tuple[str, float, list[str]]:
        """(main language, its proportion, all languages chosen)."""
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0, []
        chosen, share = self.infer(text)
        best = int(np.argmax(share))
        return self.langs[chosen[best]], float(min(max(share[best], 0.0), 1.0)), [self.langs[i] for i in chosen]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 3000, **how) -> Mixture:
    """The mixture model of the labelled texts (null labels and null texts are left out)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 languages")
    if not sizes:
        return Mixture({}, **how)
    keep = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])[F.col("lang")]
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), "id"), 11).cast("double") / float(1 << 53)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                sums[lang.as_py()] = sums.get(lang.as_py(), 0) + gram_counts(text.as_py())
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])

    got = map_texts(rows.where(chance < keep).select("text", "lang"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = got.toArrow()
    counts: dict[str, np.ndarray] = {}
    for lang in table.column("lang").unique().to_pylist():
        part = table.filter(pa.compute.equal(table.column("lang"), lang))
        counts[lang] = np.zeros(SIZE)
        counts[lang][part.column("gram").to_numpy()] = part.column("n").to_numpy()
    return Mixture(counts, **how)


def identify(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, langs) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                names=["id", "lang_pred", "score", "langs"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(texts, run, f"id {kind}, lang_pred string, score double, langs array<string>").withColumnRenamed("id", id_col)


def without_codes(text: str | None) -> str | None:
    """The words of a text without those that hold digits or an @ (numbers, addresses, keys), which say nothing of its language; the text itself, if
    no letter is left."""
    if text is None:
        return None
    plain = " ".join(w for w in text.split() if not _CODE.search(w))
    return plain if has_letter(plain) else text


def keep_identified(
    docs: DataFrame, model: Mixture, text_col: str = "text", languages: Collection[str] | None = None, min_share: float = 0.6
) -> DataFrame:
    """The rows of docs whose main language is one of `languages` (any learned one, if None) and holds at least `min_share` of the
    text's n-grams (those of words with digits or an @ left out), all columns as they are. Texts without a letter, mixtures without a main language, and texts of other
    languages go."""
    at = docs.columns.index(text_col)

    def wanted(text: str | None) -> bool:
        lang, share, _ = model.predict(without_codes(text))
        return lang != "und" and share >= min_share and (languages is None or lang in languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([wanted(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return map_texts(docs, run, docs.schema)
