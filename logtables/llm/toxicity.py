"""Toxicity by compression distance: how much shorter a window of text becomes with a dictionary of toxic text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import session_of, stage

#: Words of a window. Short enough that its literals are stored as they are, so lengths tell matches.
WINDOW = 12
#: The fit reads at most so many labelled documents of each class; all others are only scored.
DOCS_PER_CLASS = 4000
#: One in so many of them calibrates, the rest make the dictionaries.
CALIBRATE_EACH = 4
#: Bytes of the ordinary dictionary, pieces of words in the toxic one, windows that the ordinary one is trained on.
ORDINARY_BYTES, TOXIC_PIECES, ORDINARY_WINDOWS = 4096, 64, 20_000
#: Pieces are beginnings of words behind a blank, of so many bytes, blanks included.
PIECE_BYTES = (5, 12)
#: A piece is toxic if at least so many sampled documents have it, so many times as often as ordinary ones, and its
#: count is so many standard deviations above what the classes' sizes explain.
LEAST_DOCS, LEAST_RATIO, LEAST_DEVIATIONS = 5, 8.0, 5.0
#: Advantages, in bytes, that calibration chooses from.
ADVANTAGES = (1, 2, 3, 4, 5, 6)

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Model:
    """Both dictionaries, the advantage that makes a window a hit, and weights of :func:`features`."""

    ordinary: bytes
    toxic: bytes
    advantage: int
    weights: tuple[float, ...]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, len(words), WINDOW)]


@lru_cache(maxsize=4)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Frames without headers, and a dictionary of plain content: an entropy table of its own would hide matches."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=13, chain_log=13, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
    )
    # The last bytes of a dictionary are not looked up.
    dictionary = zstandard.ZstdCompressionDict(content + bytes(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary)


def advantages(text: str | None, ordinary: bytes, toxic: bytes) -> list[int]:
    """For each window, the bytes by which toxic content beside the ordinary one shortens it."""
    plain, both = compressor(ordinary).compress, compressor(ordinary + toxic).compress
    return [len(plain(w)) - len(both(w)) for w in windows_of(words_of(text))]


def counts(found: list[int]) -> list[int]:
    """Windows (at least one), the largest advantage, and the windows that reach each of ``ADVANTAGES``."""
    return [max(1, len(found)), max(found, default=0), *[sum(a >= least for a in found) for least in ADVANTAGES]]


def features(counted: np.ndarray, advantage: int) -> np.ndarray:
    """Columns of a logistic model from rows of :func:`counts`."""
    n, best, hits = counted[:, 0], np.clip(counted[:, 1], 0, None), counted[:, 2 + ADVANTAGES.index(advantage)]
    return np.column_stack([np.ones(len(n)), np.log1p(hits), np.log(n), np.log(n) * np.log1p(hits), best, hits / n])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(counted: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[int, tuple[float, ...]]:
    """The advantage and the weights of the least weighted log loss. One class alone is what every text
    gets; no labelled text at all counts as ordinary."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return ADVANTAGES[0], (30.0 if len(toxic) and toxic.max() else -30.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    tried = []
    for advantage in ADVANTAGES:
        x = features(counted, advantage)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = _logistic(x @ w)
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
            w += np.linalg.solve(curve, x.T @ (weight * (toxic - p)) - 1e-2 * w)
        p = np.clip(_logistic(x @ w), 1e-9, 1 - 1e-9)
        loss = -(weight * (toxic * np.log(p) + (1 - toxic) * np.log(1 - p))).sum()
        tried.append((loss if np.isfinite(loss) else np.inf, advantage, tuple(w)))
    return min(tried)[1:]


def toxic_content(pieces: list[tuple[bytes, int, int]], n_toxic: int, n_ordinary: int) -> bytes:
    """The toxic dictionary from pieces with their toxic and ordinary documents: those that tell the classes apart.
    A longer piece replaces its beginning if nearly as many documents have it; the most frequent come last, where
    matches are cheapest."""
    scored = []
    for piece, toxic, ordinary in pieces:
        expected = (toxic + ordinary) * n_toxic / (n_toxic + n_ordinary)
        ratio = toxic / n_toxic / ((ordinary + 0.5) / max(n_ordinary, 1)) if n_toxic else 0
        if toxic >= LEAST_DOCS and ratio >= LEAST_RATIO and toxic - expected >= LEAST_DEVIATIONS * max(expected, 0.5) ** 0.5:
            scored.append((-toxic, len(piece), piece))
    seen: dict[bytes, int] = {}
    chosen: dict[bytes, int] = {}
    for toxic, _, piece in sorted(scored):
        starts = [p for p in seen if piece.startswith(p)]
        if any(-toxic < 0.9 * seen[p] for p in starts):
            continue
        for p in starts:
            chosen.pop(p, None)
        seen[piece] = chosen[piece] = -toxic
    kept = sorted(chosen, key=lambda p: (-chosen[p], p))[:TOXIC_PIECES]
    return b"".join(reversed(kept))


def ordinary_content(windows: list[bytes]) -> bytes:
    """The content of a dictionary trained on windows of ordinary text; too few for the trainer are taken as they are."""
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, windows, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(windows)[-ORDINARY_BYTES:] or b" "


def pieces_of(words: list[bytes]) -> set[bytes]:
    least, most = PIECE_BYTES
    return {w[:n] for w in {b" " + w + b" " for w in words} for n in range(least, min(len(w), most) + 1)}


def sketch(words: list[bytes]) -> int:
    """The least hash of five consecutive words: mostly equal for near copies."""
    shingles = (b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    return min(xxhash.xxh64_intdigest(s) for s in shingles) >> 1


def resolved(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """One row per labelled document: toxic if at least half of its labels are. Null ids and labels are left out."""
    votes = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    return votes.groupBy(F.col(doc_id).alias("_id")).agg((F.avg((F.col(label) != 0).cast("int")) >= 0.5).alias("_toxic"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``DOCS_PER_CLASS`` documents of each class, drawn by a hash of the id.

    Ids are drawn from ``labels`` first, so only the texts of drawn documents leave their tasks. Near copies count
    once. Pieces are counted in Spark; what reaches the driver is bounded: the pieces of one dictionary, the
    windows of the other, and a row of counts for each calibrating document.
    """
    session_of(docs)
    known = resolved(labels, doc_id, label)
    # Ids that have a document: labels may cover others.
    order = [F.xxhash64("_id"), F.asc("_id")]
    totals = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    drawn = known.where("_toxic").orderBy(*order).limit(DOCS_PER_CLASS).unionByName(known.where("not _toxic").orderBy(*order).limit(DOCS_PER_CLASS))
    # Two bounded draws of ids, some hundred kilobytes.
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(drawn), "_id")
    sample = stage(picked.select(F.xxhash64(F.lit("part"), "_id").alias("_part"), "_toxic", "_text"), "labelled").withColumn(
        "_fits", F.pmod("_part", F.lit(CALIBRATE_EACH)) != 0
    )
    ordinary, toxic = _dictionaries(sample.where("_fits"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(advantages(t, ordinary, toxic)) for t in batch.column("_text").to_pylist()]
            yield pa.record_batch([batch.column("_toxic"), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "counts"])

    rows = sample.where("not _fits").select("_toxic", "_text").mapInArrow(counted, "toxic boolean, counts array<long>").collect()
    rows.sort(key=str)
    marks = np.array([r.toxic for r in rows], float)
    weight = np.array([totals.get(r.toxic, 0) / max(1, min(DOCS_PER_CLASS, totals.get(r.toxic, 0))) for r in rows], float)
    return Model(ordinary, toxic, *calibrate(np.array([r.counts for r in rows], float).reshape(len(rows), 2 + len(ADVANTAGES)), marks, weight))


def _dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """Ordinary and toxic content from labelled texts (``_toxic``, ``_text``)."""

    @F.arrow_udf("long")
    def sketched(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(words_of(t)) for t in texts.to_pylist()], pa.int64())

    once = sample.withColumn("_sketch", sketched(F.col("_text"))).groupBy("_toxic", "_sketch").agg(F.min("_text").alias("_text"))
    once = stage(once, "labelled-once")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column("_toxic").to_pylist(), batch.column("_text").to_pylist()):
                found[toxic].update(pieces_of(words_of(text)))
        for toxic, counter in found.items():
            names = list(counter)
            for k in range(0, len(names), 10_000):
                some = names[k : k + 10_000]
                yield pa.record_batch([pa.array(some, pa.binary()), pa.array([toxic] * len(some), pa.bool_()), pa.array([counter[p] for p in some], pa.int64())], names=["piece", "toxic", "n"])

    counted = once.select("_toxic", "_text").mapInArrow(pieces, "piece binary, toxic boolean, n long")
    both = counted.groupBy("piece").agg(*[F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias(name) for name, side in (("t", F.col("toxic")), ("o", ~F.col("toxic")))])
    sizes = {r["_toxic"]: r["count"] for r in once.groupBy("_toxic").count().collect()}
    n_toxic, n_ordinary = sizes.get(True, 0), sizes.get(False, 0)
    # Only pieces that pass anyway; fewer than the sample has words, and many beginnings of one another.
    often = both.where((F.col("t") >= LEAST_DOCS) & (F.col("t") * max(n_ordinary, 1) >= LEAST_RATIO * (F.col("o") + 0.5) * max(n_toxic, 1)))
    found = often.orderBy(F.desc("t"), "piece").limit(100 * TOXIC_PIECES).collect()
    toxic = toxic_content([(bytes(r.piece), r.t, r.o) for r in found], n_toxic, n_ordinary) if n_toxic else b""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for t in batch.column("_text").to_pylist() for w in windows_of(words_of(t))]
            yield pa.record_batch([pa.array(found, pa.binary())], names=["window"])

    windows = once.where("not _toxic").select("_text").mapInArrow(cut, "window binary")
    rows = windows.orderBy(F.xxhash64("window"), "window").limit(ORDINARY_WINDOWS).collect()
    return ordinary_content([bytes(r.window) for r in rows]), toxic


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (the calibrated probability that a text is toxic), ``predicted`` (1 from 0.5 on),
    ``n_windows`` and ``n_hits`` (windows that toxic content shortens by the calibrated advantage).

    Whole texts are cut into windows of 12 words. Empty and null texts are one window without a hit. Each row is
    scored alone; columns by the new names are replaced, and an empty table gives an empty one.
    """
    session_of(docs)
    kind = "score double, predicted int, n_windows long, n_hits long"

    @F.arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        found = [counts(advantages(t, model.ordinary, model.toxic)) for t in texts.to_pylist()]
        counted = np.array(found, float).reshape(len(found), 2 + len(ADVANTAGES))
        score = _logistic(features(counted, model.advantage) @ np.array(model.weights))
        hits = counted[:, 2 + ADVANTAGES.index(model.advantage)]
        columns = [pa.array(score), pa.array((score >= 0.5).astype("int32")), pa.array(counted[:, 0].astype("int64")), pa.array(hits.astype("int64"))]
        return pa.StructArray.from_arrays(columns, names=["score", "predicted", "n_windows", "n_hits"])

    own = [c for c in docs.columns if c not in ("score", "predicted", "n_windows", "n_hits", "_scored")]
    return docs.select(*own, scored.asNondeterministic()(F.col(text)).alias("_scored")).select(*own, "_scored.*")
