"""Quality rules: counts of words, symbols and repeats, and bands of compression ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import session_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEVEL = 3
#: Texts are also compressed in chunks of this many bytes; a rest of less than a quarter joins the chunk before.
CHUNK = 4096
#: For texts and chunks of at least so many bytes: the least and the greatest share that compression may leave. A
#: short text compresses badly whatever it says, a long one well. These are the 0.1 and 99.9 % quantiles of texts
#: that pass the base rules, widened by a quarter below and a fifth above; :func:`fit_bands` gives those of a corpus.
BANDS = (
    (0, 0.38, 0.90), (512, 0.35, 0.82), (1024, 0.31, 0.72), (2048, 0.29, 0.65), (4096, 0.27, 0.60),
    (8192, 0.26, 0.56), (16384, 0.25, 0.53), (65536, 0.24, 0.52),
)
#: The share of chunks that may be outside the band of their length.
MAX_BAD_CHUNKS = 0.34
#: Quantiles that bands are fitted to, by how much they are widened, and the texts that are measured at most.
FITTED, WIDENED, FIT_TEXTS = (0.001, 0.999), (0.75, 1.2), 20_000

Bands = tuple[tuple[int, float, float], ...]

FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()),
    ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()),
]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def count_dup_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def count_repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
    _, window, seen = np.unique(pair[:-1] * np.int64(n) + code[2:], return_inverse=True, return_counts=True)
    again = seen[window] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def chunks_of(raw: bytes) -> list[bytes]:
    starts = list(range(0, len(raw), CHUNK))
    if len(starts) > 1 and len(raw) - starts[-1] < CHUNK // 4:
        starts.pop()
    return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]


def in_band(size: int, ratio: float, bands: Bands) -> bool:
    low, high = next((low, high) for least, low, high in reversed(bands) if size >= least)
    return low <= ratio <= high


def compression(raw: bytes, compressor: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, int, int]:
    """The ratio of the whole text, its chunks, and how many of these are outside their band."""
    if not raw:
        return 0.0, 0, 0
    whole = len(compressor.compress(raw)) / len(raw)
    chunks = chunks_of(raw)
    ratios = [whole] if len(chunks) == 1 else [len(compressor.compress(c)) / len(c) for c in chunks]
    return whole, len(chunks), sum(not in_band(len(c), r, bands) for c, r in zip(chunks, ratios))


def measure(text: str | None, compressor: zstandard.ZstdCompressor, bands: Bands = BANDS) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n_words, n_repeat = len(words), count_repeat_words(words)
    # A code point is a byte that does not continue another.
    word_chars = sum(map(len, words)) - (len(raw) - len(text or ""))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    ratio, n_chunks, n_bad = compression(raw, compressor, bands)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not failed and in_band(len(raw), ratio, bands) and n_bad <= MAX_BAD_CHUNKS * n_chunks
    return n_words, word_chars, n_symbols, count_dup_lines(raw), n_repeat, failed, kept, ratio, n_chunks, n_bad


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = BANDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept``, ``ratio`` (zstandard size over size in bytes), ``n_chunks``
    and ``n_bad_chunks``.

    A text fails the base rules with fewer than 50 words or more than half of them in repeated windows
    of three. Others are kept if the ratio of the whole text is within the band of its length and not
    more than a third of its chunks are outside theirs: below are repetitive texts, above are
    incompressible ones. An empty or null text has no words, ratio 0 and fails. Each row is judged alone:
    ties, repeated and other columns change nothing, but columns by the new names are replaced. An empty
    table gives an empty one.
    """
    session_of(docs)

    @F.arrow_udf(SCHEMA)
    def judged(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        rows = [measure(t, compressor, bands) for t in texts.to_pylist()]
        columns = list(zip(*rows)) or [()] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS)], names=[n for n, _ in FIELDS])

    new = [name for name, _ in FIELDS]
    own = [c for c in docs.columns if c not in (*new, "_judged")]
    found = docs.select(*own, judged.asNondeterministic()(F.col(text)).alias("_judged"))
    return found.select(*own, "_judged.*")


def fit_bands(docs: DataFrame, text: str = "text", texts: int = FIT_TEXTS) -> Bands:
    """Bands for a corpus, from at most ``texts`` of its texts that differ, drawn by their hash, that pass the base rules.

    A length class of which the sample has no text keeps its band.
    """
    drawn = docs.select(F.col(text).alias("text")).where("text is not null").distinct().orderBy(F.xxhash64("text"), "text").limit(texts)
    passed = quality_rules(drawn).where("not base_failed").withColumn("size", F.octet_length("text"))
    least = [b[0] for b in BANDS]
    of = F.coalesce(*[F.when(F.col("size") >= n, n) for n in reversed(least)])
    shares = F.percentile("ratio", F.array(*map(F.lit, FITTED))).alias("shares")
    found = {r["least"]: r["shares"] for r in passed.groupBy(of.alias("least")).agg(shares).collect()}  # a row per class
    return tuple((n, found[n][0] * WIDENED[0], found[n][1] * WIDENED[1]) if n in found else band for n, band in zip(least, BANDS))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with their own columns."""
    judged = quality_rules(docs.select(F.struct(*docs.columns).alias("_doc")), f"_doc.{text}")
    return judged.where("kept").select("_doc.*")
