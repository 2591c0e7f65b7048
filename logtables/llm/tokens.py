"""Token ids by a public tokenizer file; exact histogram of encoded lengths."""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.llm.staging import session_of, stage

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: what a byte-level tokenizer file means by its splitting rule.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_letters() -> dict[str, int]:
    """How tokenizer files write bytes: printable ones of Latin-1 as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    """The same vocabulary for the fastest of the installed encoders.

    It merges by rank of the result, so the file must list its merges in the order of their ids; and it splits
    at added tokens, as the file's own library does.
    """
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, split, added = described["model"], described["pre_tokenizer"] or {}, described["added_tokens"]
    known = model["vocab"]
    merged = [known["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    plain = described["normalizer"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    if not (byte_level and plain and model["type"] == "BPE" and merged == sorted(merged)):
        raise ValueError("the tokenizer must be a byte-level one without a normalizer, with its merges in order")
    special = {t["content"]: t["id"] for t in added}
    of = _bytes_of_letters()
    ranks = {bytes(of[c] for c in word): k for word, k in known.items() if word not in special}
    return tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str | None, path: str) -> bytes:
    """The ids of the whole text as little-endian unsigned 32-bit numbers; null is the empty text.

    The text of an added token in ``text`` becomes its id, as it does in the tokenizer as loaded.
    """
    return _encoding(path).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""


def tokenizer_path(path: str | None) -> str:
    return path or public_tokenizers.path(TOKENIZER)


def token_lengths(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, the encoded length of the whole text; 0 for an empty or null text.
    A column by that name is replaced."""
    session_of(docs)
    path = tokenizer_path(tokenizer)

    @F.arrow_udf("long")
    def length(texts: pa.Array) -> pa.Array:
        return pa.array([len(encode(t, path)) // 4 for t in texts.to_pylist()], pa.int64())

    own = [c for c in docs.columns if c != "n_tokens"]
    return docs.select(*own, length.asNondeterministic()(F.col(text)).alias("n_tokens"))


#: Lengths are summed in blocks of this many, then over the blocks, so no task gets all lengths.
LENGTHS_PER_BLOCK = 4096


def length_histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """One row per encoded length that occurs: ``length``, ``n_docs``, ``docs_from`` and ``tokens_from``
    (documents of that length or more, and their tokens), ``docs_below`` and ``tokens_below``, and
    ``truncated_tokens``, what is left of all tokens if every document is cut to ``length``.

    Suffix sums answer other questions as well, see :func:`totals_at` and :func:`quantile`. Documents
    are counted before the shuffle; rows without a length are left out, and an empty table gives an
    empty one.
    """
    counted = lengths.where(F.col(n_tokens).isNotNull()).groupBy(F.col(n_tokens).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    # A row per length, used several times below: written once, or all texts would be encoded again for each use.
    counted = stage(counted.withColumn("tokens", F.col("length") * F.col("n_docs")), "lengths")
    counted = counted.withColumn("_block", F.floor(F.col("length") / LENGTHS_PER_BLOCK))
    blocks = counted.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    blocks = blocks.withColumn("_above", F.floor(F.col("_block") / LENGTHS_PER_BLOCK))
    tops = blocks.groupBy("_above").agg(F.sum("_docs").alias("_top_docs"), F.sum("_tokens").alias("_top_tokens"))

    def longer(window):
        return window.rowsBetween(Window.unboundedPreceding, -1)

    def over(name: str, window) -> Column:
        return F.coalesce(F.sum(name).over(longer(window)), F.lit(0))

    last = Window.partitionBy(F.lit(1)).orderBy(F.desc("_above"))  # one row per 16 million lengths
    tops = tops.select("_above", over("_top_docs", last).alias("_td"), over("_top_tokens", last).alias("_tt"))
    mid = Window.partitionBy("_above").orderBy(F.desc("_block"))
    blocks = blocks.join(tops, "_above").select(
        "_block", (F.col("_td") + over("_docs", mid)).alias("_bd"), (F.col("_tt") + over("_tokens", mid)).alias("_bt")
    )
    own = Window.partitionBy("_block").orderBy(F.desc("length"))
    summed = counted.join(blocks, "_block").select(
        "length", "n_docs", "tokens",
        (F.col("_bd") + over("n_docs", own) + F.col("n_docs")).alias("docs_from"),
        (F.col("_bt") + over("tokens", own) + F.col("tokens")).alias("tokens_from"),
    )
    total = counted.agg(F.sum("n_docs").alias("_all_docs"), F.sum("tokens").alias("_all_tokens"))
    found = summed.join(F.broadcast(total)).withColumn("tokens_below", F.col("_all_tokens") - F.col("tokens_from"))  # one row
    return found.select(
        "length", "n_docs", "docs_from", "tokens_from", (F.col("_all_docs") - F.col("docs_from")).alias("docs_below"), "tokens_below",
        (F.col("tokens_below") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
    )


def totals_at(histogram: DataFrame, limit: int) -> DataFrame:
    """For a context limit, one row: ``n_docs``, ``n_tokens``, ``truncated_docs`` (longer than the limit)
    and ``truncated_tokens`` (what is left if they are cut to it). All 0 for an empty histogram."""
    kept = F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")
    sums = {
        "n_docs": F.col("n_docs"), "n_tokens": F.col("length") * F.col("n_docs"),
        "truncated_docs": F.when(F.col("length") > limit, F.col("n_docs")), "truncated_tokens": kept,
    }
    return histogram.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row ``length``: the least length that at least ``share`` of the documents do not exceed;
    null for an empty histogram."""
    reached = (F.col("docs_below") + F.col("n_docs")) >= F.lit(share) * (F.col("docs_below") + F.col("docs_from"))
    return histogram.where(reached).agg(F.min("length").alias("length"))
