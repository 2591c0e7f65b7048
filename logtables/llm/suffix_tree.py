"""Language-model scores of texts by a probabilistic suffix tree over words.

A context is the last one to ``DEPTH`` words before a token. It is a candidate if it makes up a share
``LEAST_CONTEXT`` of all training tokens, and stays in the tree if what follows it diverges from what
follows its longest suffix; each is tested alone, and one that does not stay leaves all to its suffix.
Successors with a share ``LEAST_PAIR`` of all tokens are listed with their contexts, so there are at
most 1 / share contexts and successors of each length whatever the size of the corpus, and the tree
may be sent to every task. All shares are arguments of :func:`train`. The root is the distribution
of single words over the whole vocabulary, which is not bounded: words below a share stay in a table
and meet the texts by a join. So do, with ``whole``, all successors that are not listed: the scores are
then those of a tree that lists every successor. The logarithm of what a successor adds to its suffix
depends on context and word alone, so a token takes one addend of each level that does not list it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import hash_joins, session_of, shuffles_removed, stage
from logtables.sources.scratch import remove, scratch_dir

DEPTH = 3
LEAST_WORD = 1e-6
LEAST_CONTEXT = 2e-5
LEAST_PAIR = 1e-6
#: Bits by which a context's successors must differ from those of its suffix.
DIVERGENCE = 0.05
#: Taken from the count of each listed successor and left to the suffix.
DISCOUNT = 0.75
#: What a task has gathered goes to the shuffle, counted, when it has so many keys or its words so many bytes.
KEYS = 4_000_000
WORD_BYTES = 32 << 20
#: Texts are coded together until they have so many bytes.
TEXT_BYTES = 2 << 20
#: The token at the end of each text; no word is empty.
END = ""


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    some = pc.not_equal(pc.binary_length(words), 0)  # blanks at the beginning and the end of a text cut off nothing
    ends = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy()]
    return words.filter(some), np.diff(ends)


def _write(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back; the shuffle files of the write go at its end."""
    spark = df.sparkSession
    with shuffles_removed(spark), hash_joins(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def count_words(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` of the one column ``text``, the end of each text included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tally() -> pa.RecordBatch:
            counts = pa.chunked_array(parts, pa.string()).value_counts()
            word = pa.concat_arrays([counts.field("values"), pa.array([END])])
            return pa.record_batch([word, pa.concat_arrays([counts.field("counts"), pa.array([n_ends])])], names=["word", "n"])

        parts, size, n_ends = [], 0, 0
        for batch in batches:
            words, lengths = _words(batch.column(0))
            parts.append(words)
            size += words.nbytes
            n_ends += len(lengths)
            if size > WORD_BYTES:
                yield tally()
                parts, size, n_ends = [], 0, 0
        if n_ends:
            yield tally()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one length. They are numbered as the entries of the level below; the first as words."""

    allowed: np.ndarray
    totals: np.ndarray
    suffix: np.ndarray | None
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    words: list[str]
    root: np.ndarray
    n_tokens: int
    n_words: int
    levels: list[Level]
    #: Tells trees apart in workers, which outlive them.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: For each level ``key``, ``name``, ``n`` and ``parent`` of the successors that it does not list. A key is
    #: context * slots + word + 1; words without a number have place 0 and their name, others an empty name.
    rest: list[DataFrame] = field(default_factory=list)

    @property
    def unseen(self) -> float:
        return 0.5 / (self.n_tokens + 0.5 * (self.n_words + 1))

    @property
    def slots(self) -> int:
        return len(self.words) + 1

    def root_of(self, n: Column) -> Column:
        return (n + 0.5) / F.lit(self.n_tokens + 0.5 * (self.n_words + 1))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    order = np.argsort(wanted)  # in order each search begins where the last one ended
    ordered = wanted[order]
    at = np.minimum(np.searchsorted(keys, ordered), len(keys) - 1)
    found = np.empty(len(wanted), np.int64)
    found[order] = np.where(keys[at] == ordered, at, -1)
    return found


@dataclass
class Tokens:
    """All tokens of some texts: their numbers, -1 for words that have none; where texts begin; the words in order."""

    codes: np.ndarray
    starts: np.ndarray
    words: pa.Array

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def words_at(self, at: np.ndarray) -> pa.Array:
        """The words at these places, none of which is the end of a text."""
        return self.words.take(pa.array(at - self.text_of(at)))


def _codes(texts: pa.Array, numbered: pa.Array, end: int) -> Tokens:
    words, lengths = _words(texts)
    stops = np.cumsum(lengths + 1)
    codes = np.full(stops[-1] if len(stops) else 0, end, np.int64)
    inside = np.ones(len(codes), bool)
    inside[stops - 1] = False
    codes[inside] = pc.fill_null(pc.index_in(words, value_set=numbered), -1).to_numpy()
    return Tokens(codes, stops - lengths - 1, words)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first columns of some batches at a time."""
    parts, size = [], 0
    for batch in batches:
        parts.append(batch.column(0))
        size += batch.nbytes
        if size >= TEXT_BYTES:
            yield pa.concat_arrays(parts)
            parts, size = [], 0
    if parts:
        yield pa.concat_arrays(parts)


def _after(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value of the token before, -1 at the beginning of a text."""
    moved = np.full(len(values), -1, np.int64)
    moved[1:] = values[:-1]
    moved[starts] = -1
    return moved


def _walk(codes: np.ndarray, starts: np.ndarray, levels: list[Level], n_ids: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level the context of every token, -1 for none, and the entry of the token in it, -1 for none."""
    below = codes
    for level in levels:
        context = _after(below, starts)
        if len(level.allowed):
            context = np.where((context >= 0) & level.allowed[np.maximum(context, 0)], context, -1)
        entry = np.full(len(codes), -1, np.int64)
        some = np.flatnonzero((context >= 0) & (codes >= 0))
        entry[some] = _lookup(level.keys, context[some] * n_ids + codes[some])
        yield context, entry
        below = entry


_IDS: dict[str, tuple[pa.Array, int]] = {}


def _ids(broadcast) -> tuple[pa.Array, int]:
    """A tree's words by their numbers and the number of the end of a text, made once per worker."""
    if broadcast.value[0] not in _IDS:
        _IDS.clear()
        words = broadcast.value[1].words
        _IDS[broadcast.value[0]] = pa.array(words, pa.string()), words.index(END)
    return _IDS[broadcast.value[0]]


def _share_out(spark, tree: Tree):
    return spark.sparkContext.broadcast((tree.name, replace(tree, rest=[])))


def _tally(group: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The different pairs, in order of their groups, and how often each occurs."""
    encoded, (groups, at) = words.dictionary_encode(), np.unique(group, return_inverse=True)
    size = len(encoded.dictionary) + 1
    pairs, n = np.unique(at * size + encoded.indices.to_numpy(), return_counts=True)
    return groups[pairs // size], encoded.dictionary.take(pa.array(pairs % size)), n.astype(np.int64)


def _bound(share: float, n_tokens: int) -> float:
    """The least count of a share of all tokens: what occurs once counts only if the share is 0."""
    return max(2.0, share * n_tokens) if share else 1.0


def _count_successors(texts: DataFrame, shared, whole: bool) -> DataFrame:
    """``key``, ``name`` and ``n`` of all that follows the contexts of the last level; without ``whole``
    of words that have a number only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tree, keys, named, words, size, held = _ids(shared), shared.value[1], [], [], [], 0, 0

        def tally() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            of, name, times = _tally(np.concatenate(named), pa.concat_arrays(words))
            name = pa.concat_arrays([pa.repeat("", len(key)), name])
            return pa.record_batch([pa.array(np.append(key, of)), name, pa.array(np.append(n.astype(np.int64), times))], names=["key", "name", "n"])

        for together in _together(batches):
            tokens = _codes(together, *ids)
            *_, (context, _) = _walk(tokens.codes, tokens.starts, tree.levels, len(tree.words))
            some = (context >= 0) & (tokens.codes >= 0)
            keys.append(context[some] * tree.slots + tokens.codes[some] + 1)
            at = np.flatnonzero((context >= 0) & (tokens.codes < 0)) if whole else np.zeros(0, np.int64)
            named.append(context[at] * tree.slots)
            words.append(tokens.words_at(at))
            size += len(keys[-1]) + len(at)
            held += words[-1].nbytes
            if size > KEYS or held > WORD_BYTES:
                yield tally()
                keys, named, words, size, held = [], [], [], 0, 0
        if keys:
            yield tally()

    return texts.mapInArrow(count, "key long, name string, n long").groupBy("key", "name").agg(F.sum("n").alias("n"))


def _listed(counted: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (context * words + word) and counts."""
    table = counted.select("key", "n").toArrow()
    key, n = table["key"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    context, word = key[order] // tree.slots, key[order] % tree.slots - 1
    return context * len(tree.words) + word, n[order]


def _rest(unlisted: DataFrame, tree: Tree, shared, words: DataFrame) -> DataFrame:
    """The unlisted successors of the last level with ``parent``, their probability after the suffix."""
    depth = len(tree.levels)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[1]
        level = tree.levels[depth - 1]
        for batch in batches:
            key = batch.column(0).to_numpy()
            context, word = key // tree.slots, key % tree.slots - 1
            below, known = level.suffix[context], word >= 0
            parent = np.ones(len(key))
            parent[known] = _probability(tree, depth - 1, below[known], word[known])
            columns = [*batch.columns, pa.array(below * tree.slots + word + 1), pa.array(parent)]
            yield pa.record_batch(columns, names=["key", "name", "n", "below", "parent"])

    fields = "key long, name string, n long, below long, parent double"
    if depth == 1:
        single = pa.table({"word": np.arange(1, tree.slots), "parent": tree.root})
        single = words.sparkSession.createDataFrame(single)
        numbered = unlisted.where("name = ''").join(single, F.expr(f"key % {tree.slots}") == F.col("word")).select("key", "name", "n", "parent")
        root = words.select(F.col("word").alias("name"), tree.root_of(F.col("n")).alias("parent"))
        found = numbered.unionByName(unlisted.where("name != ''").join(root, "name"))
    else:
        # What the level below does not list either has its probability there; else the tree tells.
        last = tree.levels[-1]
        wanted = np.zeros(len(tree.levels[-2].totals), bool)
        wanted[last.suffix[last.allowed]] = True
        lower = _settled(tree.rest[-1], tree, depth - 1, 0, wanted).select(F.col("key").alias("below"), "name", "p")
        found = unlisted.mapInArrow(add, fields).join(lower, ["below", "name"], "left").withColumn("parent", F.coalesce("p", "parent"))
    return _write(found.select("key", "name", "n", "parent"), scratch_dir(words.sparkSession, "rest"))


def _settled(rest: DataFrame, tree: Tree, depth: int, moved: int, wanted: np.ndarray) -> DataFrame:
    """``key`` moved by a number, ``name``, the probability ``p`` after the context, and ``more``: its log10 less that
    of what the context leaves to its suffix; 0 for contexts that do not stay. Of ``wanted`` contexts only."""
    level = tree.levels[depth - 1]
    at = np.flatnonzero(wanted)
    contexts = pa.table({"context": at, "total": level.totals[at], "kept": level.kept[at]})
    left = F.col("kept") * F.col("parent")
    p = F.when(F.col("kept") < 1, (F.col("n") - F.lit(DISCOUNT)) / F.col("total") + left).otherwise(F.col("parent"))
    met = rest.join(rest.sparkSession.createDataFrame(contexts), F.expr(f"key div {tree.slots}") == F.col("context"))
    met = met.select((F.col("key") + moved).alias("key"), "name", p.alias("p"), left.alias("left"))
    return met.select("key", "name", "p", F.log10(F.col("p") / F.col("left")).alias("more"))


def _moves(tree: Tree) -> list[int]:
    """By what the keys of each level are moved, so that those of all levels differ."""
    return [tree.slots * sum(len(x.kept) for x in tree.levels[:k]) for k in range(len(tree.levels))]


def _sums(rest: DataFrame, tree: Tree, size: int) -> list[np.ndarray]:
    """For each context of the last level the number of unlisted successors, and the sums of their counts, of
    their parents' probabilities and of counts times the bits by which logs of counts exceed those of parents."""
    context = F.expr(f"key div {tree.slots}").alias("context")
    bits = F.col("n") * (F.log2(F.col("n").cast("double")) - F.log2("parent"))
    table = rest.groupBy(context).agg(F.count("*"), F.sum("n"), F.sum("parent"), F.sum(bits)).toArrow()
    at = table.column(0).to_numpy().astype(np.int64)
    return [np.bincount(at, table.column(k).to_numpy().astype(np.float64), size) for k in range(1, 5)]


def _probability(tree: Tree, depth: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of ``word`` after contexts of ``depth`` words by the levels below and including it."""
    if depth == 0:
        return tree.root[word]
    level = tree.levels[depth - 1]
    suffix = context if level.suffix is None else level.suffix[context]
    entry = _lookup(level.keys, context * len(tree.words) + word)
    listed = np.where(entry >= 0, level.share[np.maximum(entry, 0)] if len(level.share) else 0.0, 0.0)
    return listed + level.kept[context] * _probability(tree, depth - 1, suffix, word)


def train(
    texts: DataFrame,
    depth: int = DEPTH,
    least_word: float = LEAST_WORD,
    least_context: float = LEAST_CONTEXT,
    least_pair: float = LEAST_PAIR,
    divergence: float = DIVERGENCE,
    whole: bool = False,
) -> tuple[Tree, DataFrame]:
    """The tree of the one column ``text``, and the table ``word``, ``n`` of all its words.

    Words below the share ``least_word`` of all tokens stay in the table and out of contexts; contexts and
    successors that occur once or below ``least_context`` and ``least_pair`` are not listed, and contexts whose
    successors diverge by less than ``divergence`` bits leave them to their suffixes. A share of 0 leaves out
    nothing: the tree is then that of all counts, and grows with the corpus. Shares above 0 bound what the
    driver and each worker hold; what they leave out is scored by shorter contexts. Null texts are empty.

    With ``whole`` no successor is left out: those below ``least_pair`` and words without a number are kept in
    tables, count in the divergence of their contexts and in what these leave to their suffixes, and meet the texts
    by a join. Scores are then those of ``least_word`` and ``least_pair`` 0, if contexts are no rarer than words.
    """
    words = _write(count_words(texts), scratch_dir(texts.sparkSession, "words"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_tokens, n_words = int(total[0]), int(total[1])
    often = words.where((F.col("n") >= least_word * n_tokens) | (F.col("word") == END)).toArrow()
    table = dict(zip(often["word"].to_pylist(), often["n"].to_pylist()))
    table.setdefault(END, 0)
    order = sorted(table, key=lambda w: (-table[w], w))
    counts = np.array([table[w] for w in order], dtype=np.float64)
    tree = Tree(order, (counts + 0.5) / (n_tokens + 0.5 * (n_words + 1)), n_tokens, n_words, [])
    totals, suffix = counts, None
    for length in range(1, depth + 1):
        allowed = totals >= _bound(least_context, n_tokens)
        level = Level(allowed, totals, suffix, kept=np.ones(len(totals)))
        tree.levels.append(level)
        if not allowed.any():
            tree.levels.pop()
            break
        shared = _share_out(texts.sparkSession, tree)
        counted, often = _count_successors(texts, shared, whole), F.col("n") >= _bound(least_pair, n_tokens)
        if whole:
            staged = scratch_dir(texts.sparkSession, "successors")
            counted = _write(counted, staged)
            rest = _rest(counted.where(~often | (F.col("name") != "")), tree, shared, words)
            unlisted, n_unlisted, parents, bits = _sums(rest, tree, len(totals))
        else:
            unlisted = n_unlisted = parents = bits = np.zeros(len(totals))
        keys, n = _listed(counted.where(often & (F.col("name") == "")), tree)
        if whole:
            remove(texts.sparkSession, staged)
        context, word = keys // len(order), keys % len(order)
        own = n / totals[context]
        parent = _probability(tree, length - 1, context if suffix is None else suffix[context], word)
        every = np.maximum(totals, 1)
        listed = np.bincount(context, own, len(totals)) + n_unlisted / every
        expected = np.bincount(context, parent, len(totals)) + parents
        left, left_expected = np.clip(1 - listed, 1e-12, 1), np.clip(1 - expected, 1e-12, 1)
        gain = np.bincount(context, own * np.log2(own / parent), len(totals)) + left * np.log2(left / left_expected)
        gain += (bits - n_unlisted * np.log2(every)) / every
        retained = allowed & (gain >= divergence)
        level.keys = keys
        level.share = np.where(retained[context], (n - DISCOUNT) / totals[context], 0.0)
        level.kept = 1 - np.bincount(context, level.share, len(totals)) - np.where(retained, (n_unlisted - DISCOUNT * unlisted) / every, 0.0)
        if whole:
            tree.rest.append(rest)
        # The suffix of an entry: its word after the suffix of its context.
        suffix = word if level.suffix is None else _lookup(tree.levels[-2].keys, level.suffix[context] * len(order) + word)
        totals = np.where(suffix >= 0, n, 0).astype(np.float64)
    return tree, words


def score(docs: DataFrame, tree: Tree, words: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Both scores are sums of log10 over the words and the end of the whole text: ``base_score`` by single
    words, ``score`` by the longest context in the tree, which leaves what it does not list to its
    suffix and at last to the single words. An empty or null text is its end alone. With no training
    texts nothing is known and both scores are what half a count gives. Repeated rows score alike.
    Columns by the new names are replaced. An empty table gives an empty one. Of a tree of ``whole``, tokens that a
    context does not list meet its table of the others.
    """
    spark = session_of(docs)
    shared, n_ids, moves, whole = _share_out(spark, tree), len(tree.words), _moves(tree), bool(tree.rest)
    fields = (
        "n_tokens long, n_known long, base double, score double, rare array<struct<word: string, n: long>>,"
        "unlisted array<long>, named array<struct<key: long, name: string>>"
    )

    @F.arrow_udf(fields)
    def scored(texts: pa.Array) -> pa.Array:
        ids, own = _ids(shared), shared.value[1]
        tokens = _codes(texts, *ids)
        codes, starts = tokens.codes, tokens.starts
        root = np.where(codes >= 0, own.root[np.maximum(codes, 0)], 1.0)
        listed, keys, at = root.copy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for level, moved, (context, entry) in zip(own.levels, moves, _walk(codes, starts, own.levels, n_ids)):
            kept = np.where(context >= 0, level.kept[np.maximum(context, 0)], 1.0)
            found = np.where(entry >= 0, level.share[np.maximum(entry, 0)], 0.0) if len(level.share) else 0.0
            listed = found + kept * listed
            if whole:
                at.append(np.flatnonzero((entry < 0) & (kept < 1)))
                keys.append(context[at[-1]] * own.slots + codes[at[-1]] + 1 + moved)
        known = codes >= 0
        stops = np.append(starts[1:], len(codes))[: len(starts)]
        base, best = np.log10(root), np.log10(listed)
        sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (base, best, known.astype(np.int64))]
        has = own.root[ids[1]] > own.unseen
        places, every = np.flatnonzero(~known), np.arange(len(starts) + 1)
        of, word, times = _tally(tokens.text_of(places), tokens.words_at(places))
        rare = pa.StructArray.from_arrays([word, pa.array(times)], names=["word", "n"])
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, every).astype(np.int32)), rare)
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(at, kind="stable")
        keys, at = keys[order], at[order]
        ends, numbered = np.append(starts, len(codes)), codes[at] >= 0
        offsets = [pa.array(np.searchsorted(x, ends).astype(np.int32)) for x in (at[numbered], at[~numbered])]
        names = tokens.words_at(at[~numbered])
        unlisted = pa.ListArray.from_arrays(offsets[0], pa.array(keys[numbered]))
        named = pa.ListArray.from_arrays(offsets[1], pa.StructArray.from_arrays([pa.array(keys[~numbered]), names], names=["key", "name"]))
        n_known = sums[2].astype(np.int64) - (0 if has else 1)
        return pa.StructArray.from_arrays(
            [pa.array(stops - starts), pa.array(n_known), pa.array(sums[0]), pa.array(sums[1]), rare, unlisted, named],
            names=["n_tokens", "n_known", "base", "score", "rare", "unlisted", "named"],
        )

    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    own = [c for c in (docs.columns if keep is None else keep) if c not in (*new, "_row", "_s")]
    rows = stage(docs.select(*own, F.monotonically_increasing_id().alias("_row"), scored.asNondeterministic()(F.col(text)).alias("_s")), "scored")
    rare = rows.select("_row", F.explode("_s.rare").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    met = rare.join(words, "word", "left")
    base = F.col("times") * F.log10(tree.root_of(F.coalesce("n", F.lit(0))))
    known = F.when(F.col("n").isNotNull(), F.col("times"))
    addends = met.groupBy("_row").agg(F.sum(base).alias("base"), F.lit(0.0).alias("more"), F.sum(known).alias("known"))
    if whole:
        # One table after the other, so that the disk holds the shuffle of one join.
        addends = _write(addends, scratch_dir(spark, "addends"))
        for column, named, on in (("unlisted", "name = ''", ["key"]), ("named", "name != ''", ["key", "name"])):
            met = rows.select("_row", F.explode(f"_s.{column}").alias("key"))
            met = met.select("_row", "key.*") if column == "named" else met
            parts = [_settled(x.where(named), tree, k + 1, moves[k], tree.levels[k].kept < 1) for k, x in enumerate(tree.rest)]
            table = reduce(DataFrame.unionByName, parts).where("more > 0").select(*on, "more")
            sums = met.join(table, on).groupBy("_row").agg(F.lit(0.0).alias("base"), F.sum("more").alias("more"), F.lit(None).cast("long").alias("known"))
            addends = addends.unionByName(_write(sums, scratch_dir(spark, "addends")))
        addends = addends.groupBy("_row").agg(*[F.sum(x).alias(x) for x in ("base", "more", "known")])
    joined = rows.join(addends, "_row", "left")
    base, more = F.coalesce("base", F.lit(0.0)), F.coalesce("more", F.lit(0.0))
    return joined.select(
        *own, F.col("_s.n_tokens").alias("n_tokens"), (F.col("_s.n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tree.n_tokens).cast("long").alias("train_tokens"), (F.col("_s.base") + base).alias("base_score"), (F.col("_s.score") + base + more).alias("score"),
    )
