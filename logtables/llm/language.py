"""Language identification by known words, backing off to character n-grams for others."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import session_of, stage

#: The model is fitted on about so many documents of each language, drawn by a hash of the id.
DOCS_PER_LANGUAGE = 4000
#: A word or n-gram belongs to the model if this share of all words or n-grams of a language is it,
#: so their number is bounded whatever the size of the sample.
LEAST_WORD_SHARE = 2e-6
LEAST_GRAM_SHARE = 5e-6
LONGEST_GRAM = 5
#: Natural logarithm of what each step to a shorter n-gram costs; equal for all languages.
BACKOFF = math.log(0.4)
#: A worker forgets the words it has scored when it knows so many.
REMEMBERED = 300_000
UNDETERMINED = "und"

_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in _RUNS.findall(text.lower())]


def grams_of(word: str) -> Iterator[str]:
    padded = f" {word} "
    for n in range(1, LONGEST_GRAM + 1):
        for at in range(len(padded) - n + 1):
            yield padded[at : at + n]


@dataclass
class Model:
    """Rows of logarithms, a column per language: of each known word, n-gram, and of what is unknown."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray

    def score_unseen(self, word: str) -> np.ndarray:
        """The mean over the places of a word of its longest known n-gram that begins there."""
        padded, found, places, steps = f" {word} ", [], 0, 0
        for at in range(len(padded) - 1):
            places += 1
            for n in range(min(LONGEST_GRAM, len(padded) - at), 0, -1):
                row = self.grams.get(padded[at : at + n])
                if row is not None:
                    found.append(row)
                    break
                steps += 1
        if not found:
            return np.zeros(len(self.languages))
        return self.gram_rows[found].sum(axis=0) / places + steps * BACKOFF / places


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows = dict(self.model.words)
        self.table = self.model.word_rows
        self.used = len(self.table)

    def row(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(1024, len(self.table)), len(self.model.languages)))])
        self.table[self.used] = self.model.score_unseen(word)
        self.rows[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = [w for w in words_of(text or "") if w]
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        if len(self.rows) > REMEMBERED + len(self.model.words):
            self.reset()
        rows = self.rows
        at = [rows[w] if w in rows else self.row(w) for w in words]
        total = self.table[at].sum(axis=0) + self.model.prior
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def _count(texts: DataFrame, field: str) -> DataFrame:
    """``lang``, ``item``, ``n`` of the words or n-grams of rows (``lang``, ``text``), added up per batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, item, n in zip(*[c.to_pylist() for c in batch.columns]):
                own = counts.setdefault(lang, Counter())
                if field == "words":
                    own.update(w for w in words_of(item) if w)
                else:
                    for gram in grams_of(item):
                        own[gram] += n
            rows = [(lang, item, n) for lang, own in counts.items() for item, n in own.items()]
            columns = list(zip(*rows)) or [()] * 3
            kinds = [pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "item", "n"])

    counted = texts.mapInArrow(count, "lang string, item string, n long")
    return counted.groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, least: float, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Items with at least a share ``least`` in some language and their counts by language.

    There are at most 1 / least items for each language; only these come to the driver.
    """
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    wide = counts.join(F.broadcast(totals), "lang")  # one row per language
    often = wide.groupBy("item").agg(F.max(F.col("n") / F.col("total")).alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    kept = often.where(F.col("share") >= least).select("item", F.array(*[F.coalesce(F.col("by")[lang], F.lit(0)) for lang in languages]).alias("n"))
    table = kept.toArrow()
    items = table["item"].to_pylist()
    numbers = np.array(table["n"].to_pylist(), dtype=np.float64).reshape(len(items), len(languages))
    order = sorted(range(len(items)), key=items.__getitem__)
    return [items[k] for k in order], numbers[order]


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(counts) + 1)))


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    least_word_share: float = LEAST_WORD_SHARE,
    least_gram_share: float = LEAST_GRAM_SHARE,
) -> Model:
    """A model from rows with a text and a language.

    The sample is, of each language, the share of documents that makes ``docs_per_language``; which ones
    is decided by a hash of the id, so reruns agree. Counts of words and n-grams are made on Spark. Words and
    n-grams below their share in every language are not known to the model; a share of 0 leaves out none.
    The model has a column per language, so labels should be clean.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("item"), F.xxhash64(F.col(doc_id)).alias("h"))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    cut = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / totals[k]))])
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < cut[F.col("lang")] * float(1 << 30))
    words = _count(drawn.select("lang", "item", F.lit(1).cast("long").alias("n")), "words")
    words = stage(words, "words")
    known, word_counts = _frequent(words, least_word_share, languages)
    grams, gram_counts = _frequent(_count(words.select("lang", "item", "n"), "grams"), least_gram_share, languages)
    n = np.array([totals[k] for k in languages], dtype=np.float64)
    # n-grams compete with those of their own length.
    length = np.array([len(g) for g in grams])
    gram_rows = np.zeros_like(gram_counts)
    for size in range(1, LONGEST_GRAM + 1):
        if (length == size).any():
            gram_rows[length == size] = _logs(gram_counts[length == size])
    return Model(
        languages, np.log(n / n.sum()), dict(zip(known, range(len(known)))), _logs(word_counts), dict(zip(grams, range(len(grams)))), gram_rows
    )


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability that the model gives it, 0 to 1.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was
    learned. Of languages that score the same the first by code point is taken. Only the text decides,
    so repeated rows agree. Columns by the new names are replaced. An empty table gives an empty one.
    """
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(model)
    kept: dict[str, Scorer] = {}

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        if "scorer" not in kept:
            kept["scorer"] = Scorer(shared.value)
        rows = [kept["scorer"].predict(t) for t in texts.to_pylist()]
        labels, scores = zip(*rows) if rows else ((), ())
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "_found")]
    return docs.select(*own, predicted.asNondeterministic()(F.col(text)).alias("_found")).select(*own, "_found.*")
