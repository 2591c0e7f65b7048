import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logtables.llm import language, suffix_tree
from logtables.llm.staging import crc32_of_id
from tests.llm import fixtures


def labelled(spark, n=240):
    rng, rows = random.Random(4), []
    parts = {"en": ["th", "ing", "er", "an", "st", "ow"], "fr": ["eau", "ou", "é", "qu", "ai", "oi"], "de": ["sch", "ung", "ei", "ch", "ü", "pf"]}
    for k in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 60)))
        rows.append((k, text.capitalize() + ".", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_language_of_held_out_texts(spark):
    docs = labelled(spark).withColumn("held_out", crc32_of_id() % 4 == 2)
    model = language.train(docs.where("not held_out"))
    found = language.identify(docs, model).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    odd = language.identify(fixtures.frame(spark), model).collect()
    assert len(odd) == len(fixtures.rows())
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    # Unseen words are scored by their n-grams.
    scorer = language.Scorer(model)
    assert scorer.predict("schungschungpfei")[0] == "de" and scorer.predict("²³ _ 12")[0] == "und"
    unseen = language.train(labelled(spark).where("doc_id < 0"))
    assert {r.lang_pred for r in language.identify(docs, unseen).collect()} == {"und"}
    assert language.identify(fixtures.frame(spark, []), model).count() == 0


def test_backoff_takes_the_longest_known_gram():
    rows = np.array([[-1.0, -2.0], [-3.0, -1.0]])
    model = language.Model(["a", "b"], np.zeros(2), {}, np.zeros((0, 2)), {"ab": 0, "b": 1}, rows)
    # Nothing known begins at the first place (4 steps), "ab" at the second (1) and "b" at the third (1).
    assert model.score_unseen("ab") == pytest.approx((rows[0] + rows[1] + 6 * language.BACKOFF) / 3)
    assert (model.score_unseen("zz") == 0).all()


def plain_language(rows, word_share, gram_share):
    """The model of all rows from plain counters: predictions of texts."""
    by, weights = {}, {}
    for _, text, lang in rows:
        by.setdefault(lang, Counter()).update(w for w in language.words_of(text) if w)
        weights[lang] = weights.get(lang, 0) + 1
    langs = sorted(by)
    grams = {lang: Counter() for lang in langs}
    for lang in langs:
        for word, n in by[lang].items():
            for g in language.grams_of(word):
                grams[lang][g] += n

    def known(counts, share):
        return {x for c in counts.values() for x, n in c.items() if n >= share * sum(c.values())}

    def logs(counts, items):
        total = {lang: sum(counts[lang][x] for x in items) for lang in langs}
        return {x: [math.log((counts[lang][x] + 0.5) / (total[lang] + 0.5 * (len(items) + 1))) for lang in langs] for x in items}

    words = logs(by, known(by, word_share))
    of_length = {}
    for g in known(grams, gram_share):
        of_length.setdefault(len(g), set()).add(g)
    parts = {g: row for items in of_length.values() for g, row in logs(grams, items).items()}

    def unseen(word):
        padded, total, steps = f" {word} ", [0.0] * len(langs), 0
        for at in range(len(padded) - 1):
            longest = next((n for n in range(5, 0, -1) if at + n <= len(padded) and padded[at : at + n] in parts), 0)
            steps += min(5, len(padded) - at) - longest
            if longest:
                total = [a + b for a, b in zip(total, parts[padded[at : at + longest]])]
        return [(x + steps * math.log(0.4)) / (len(padded) - 1) for x in total]

    def predict(text):
        found = [w for w in language.words_of(text) if w]
        total = [math.log(weights[lang] / sum(weights.values())) for lang in langs]
        for w in found:
            total = [a + b for a, b in zip(total, words.get(w) or unseen(w))]
        best = max(range(len(langs)), key=total.__getitem__)
        return langs[best], 1 / sum(math.exp(x - total[best]) for x in total)

    return predict, words, parts


@pytest.mark.parametrize("word_share, gram_share", [(0, 0), (0.004, 0.001)])
def test_language_model_is_that_of_plain_counts(spark, word_share, gram_share):
    docs = labelled(spark, 90)
    rows = [tuple(r) for r in docs.collect()]
    model = language.train(docs, docs_per_language=10**6, least_word_share=word_share, least_gram_share=gram_share)
    predict, words, parts = plain_language(rows, word_share, gram_share)
    assert set(model.words) == set(words) and set(model.grams) == set(parts)
    for items, table, plain in ((model.words, model.word_rows, words), (model.grams, model.gram_rows, parts)):
        for item, row in items.items():
            assert table[row] == pytest.approx(plain[item])
    scorer, other = language.Scorer(model), [r[1] for r in labelled(spark, 120).collect()[90:]]
    for text in [r[1] for r in rows] + other + ["eauqui", "schung the", "ing" * 9]:
        lang, score = scorer.predict(text)
        assert (lang, pytest.approx(score)) == predict(text)


def corpus(spark):
    rng, rows = random.Random(8), []
    words = [f"w{k}" for k in range(30)]
    phrase = ["red", "green", "blue", "black"]
    for k in range(300):
        text = [w for _ in range(rng.randint(0, 12)) for w in (phrase if rng.random() < 0.2 else [rng.choice(words)])]
        rows.append((k, " ".join(text).upper() if k % 5 else " ".join(text) + f" rare{k}"))
    rows += [(None, None), (7, "  "), (301, "W1 w1 \t never seen before")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_scores(spark):
    docs, rows = corpus(spark)
    docs = docs.withColumn("held_out", crc32_of_id() % 5 == 1).withColumn("score", crc32_of_id())
    tree, words = suffix_tree.train(docs.where("not held_out").select("text"))
    found = suffix_tree.score(docs, tree, words).collect()
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    tokens = [(d, [*(t or "").lower().split(), ""]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
    ids = {w: k for k, w in enumerate(tree.words)}
    assert set(ids) == set(counts)  # all words of so small a corpus are frequent

    def probability(history, word):
        """By the longest suffix, through plain dictionaries of the tree's arrays."""
        p = base(word)
        context = None
        for k, level in enumerate(tree.levels):
            if len(history) <= k:
                break
            chain = history[len(history) - k - 1 :]
            context = ids.get(chain[0], -1)
            for depth, w in enumerate(chain[1:]):
                if context < 0 or not tree.levels[depth].allowed[context]:
                    context = -1
                    break
                context = int(suffix_tree._lookup(tree.levels[depth].keys, np.array([context * len(ids) + ids.get(w, -10**9)]))[0])
            if context is None or context < 0 or not level.allowed[context]:
                break
            entry = int(suffix_tree._lookup(level.keys, np.array([context * len(ids) + ids.get(word, -10**9)]))[0])
            p = (level.share[entry] if entry >= 0 else 0.0) + level.kept[context] * p
        return p

    wanted = {}
    for d, ws in tokens:
        wanted.setdefault(d, []).append((
            len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10(base(w)) for w in ws), 6),
            round(sum(math.log10(probability(ws[:k], w)) for k, w in enumerate(ws)), 6),
        ))
    got = {}
    for r in found:
        assert r.train_tokens == n and r.held_out == held(r.doc_id)
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in wanted.items()}
    # Each state's probabilities of all words and of one unseen sum to one.
    for history in ([], ["red"], ["red", "green"], ["green", "blue"], ["w1"], ["w1", "red"]):
        total = sum(probability(history, w) for w in counts) + probability(history, "unknown")
        assert total == pytest.approx(1)
    assert probability(["red"], "green") > 0.5 > base("green")
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)


def test_rare_words_meet_by_join(spark):
    docs, _ = corpus(spark)
    tree, words = suffix_tree.train(docs.select("text"))
    before = sorted(map(tuple, suffix_tree.score(docs, tree, words).drop("doc_id", "text").collect()))
    tree, words = suffix_tree.train(docs.select("text"), least_word=0.01)
    assert len(tree.words) < words.count()
    after = sorted(map(tuple, suffix_tree.score(docs, tree, words).drop("doc_id", "text").collect()))
    assert [x[:3] for x in after] == [x[:3] for x in before]
    for k in (3, 4):
        assert sorted(x[k] for x in after) == pytest.approx(sorted(x[k] for x in before))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    tree, words = suffix_tree.train(docs.where("doc_id > 9").select("text"))
    found = {r.doc_id: r for r in suffix_tree.score(docs, tree, words).collect()}
    assert found[1].n_known == 0 and found[1].train_tokens == 0 and found[1].n_tokens == 3 and found[2].n_tokens == 1
    assert found[1].base_score == pytest.approx(3 * math.log10(0.5 / 0.5)) and suffix_tree.score(docs.limit(0), tree, words).count() == 0


def plain_tree(texts, depth, least_context, least_pair, divergence):
    """Retained contexts with their listed shares, and the probability of a word, from plain dictionaries."""
    tokens = [[*(t or "").lower().split(), ""] for t in texts]
    counts = Counter(w for ws in tokens for w in ws)
    n_tokens, n_words = sum(counts.values()), len(counts)
    shares, kept = {}, {}

    def p(context, word):
        if not context:
            return (counts[word] + 0.5) / (n_tokens + 0.5 * (n_words + 1))
        return shares.get(context, {}).get(word, 0.0) + kept.get(context, 1.0) * p(context[1:], word)

    def least(share):
        return max(2, share * n_tokens) if share else 1

    totals, seen = {(w,): n for w, n in counts.items()}, None
    for length in range(1, depth + 1):
        allowed = {c for c, n in totals.items() if n >= least(least_context)}
        follows = Counter((tuple(ws[i - length : i]), ws[i]) for ws in tokens for i in range(length, len(ws)) if tuple(ws[i - length : i]) in allowed)
        follows = {k: n for k, n in follows.items() if n >= least(least_pair)}
        found = {}
        for (c, w), n in follows.items():
            found.setdefault(c, {})[w] = n
        for c, after in found.items():
            own, parent = {w: n / totals[c] for w, n in after.items()}, {w: p(c[1:], w) for w in after}
            rest, rest_parent = (max(1e-12, 1 - sum(x.values())) for x in (own, parent))
            gain = sum(own[w] * math.log2(own[w] / parent[w]) for w in after) + rest * math.log2(rest / rest_parent)
            if gain >= divergence:
                shares[c] = {w: (n - 0.75) / totals[c] for w, n in after.items()}
                kept[c] = 1 - sum(shares[c].values())
        totals = {(*c, w): n for (c, w), n in follows.items() if seen is None or (c[1:], w) in seen}
        seen = follows
    return shares, p


@pytest.mark.parametrize("least_context, least_pair, divergence", [(0, 0, 0.0), (0, 0, 0.05), (0.004, 0.002, 0.05), (0.01, 0.0008, 0.4)])
def test_tree_is_that_of_plain_counts(spark, least_context, least_pair, divergence):
    docs, rows = corpus(spark)
    texts = [t for _, t in rows]
    tree, words = suffix_tree.train(docs.select("text"), 3, 0, least_context, least_pair, divergence)
    shares, p = plain_tree(texts, 3, least_context, least_pair, divergence)
    found = {}
    names = [(w,) for w in tree.words]  # of the entries of each level
    for level in tree.levels:
        contexts, names = names, [names_of(names, key, tree) for key in level.keys.tolist()]
        for key, share in zip(level.keys.tolist(), level.share.tolist()):
            if share:
                found.setdefault(contexts[key // len(tree.words)], {})[tree.words[key % len(tree.words)]] = share
    assert found.keys() == shares.keys()
    for context, after in shares.items():
        assert found[context] == pytest.approx(after)
    got = {}
    for r in suffix_tree.score(docs, tree, words).collect():
        got.setdefault(r.text, set()).add(round(r.score, 6))
    for text in set(texts):
        ws = [*(text or "").lower().split(), ""]
        assert got[text] == {round(sum(math.log10(p(tuple(ws[max(0, k - 3) : k]), w)) for k, w in enumerate(ws)), 6)}


@pytest.mark.parametrize("least_word, least_context, least_pair", [(0, 0.004, 0.002), (0.003, 0.004, 0.003), (0.01, 0.01, 0.05)])
def test_what_a_whole_tree_does_not_list_meets_by_join(spark, least_word, least_context, least_pair):
    """The scores are those of a tree that lists all successors, of trained and of other texts."""
    docs, rows = corpus(spark)
    some = [t for d, t in rows if d is not None and d % 3]
    texts = docs.where("doc_id % 3 != 0").select("text")
    tree, words = suffix_tree.train(texts, 3, least_word, least_context, least_pair, 0.02, whole=True)
    _, p = plain_tree(some, 3, least_context, 0, 0.02)
    assert len(tree.rest) == len(tree.levels) > 1 and tree.rest[0].count() > 0
    got = {}
    for r in suffix_tree.score(docs, tree, words).collect():
        got.setdefault(r.text, set()).add(round(r.score, 6))
    for text in {t for _, t in rows}:
        ws = [*(text or "").lower().split(), ""]
        assert got[text] == {round(sum(math.log10(p(tuple(ws[max(0, k - 3) : k]), w)) for k, w in enumerate(ws)), 6)}
    cut = suffix_tree.score(docs, *suffix_tree.train(texts, 3, least_word, least_context, least_pair, 0.02)).collect()
    assert {round(r.score, 6) for r in cut} != {x for xs in got.values() for x in xs}


def test_words_are_split_as_bytes_are():
    texts = ["", None, " a  B\tc\x0b\x0cd\r\n", "\x1c\x1d a\x85b c\u2003 \x00 z", "É ÀB ß İ", "   ", "x", *(f"{chr(c)}a{chr(c)}B" for c in range(300))]
    plain = [(t or "").encode().lower().split() for t in texts]
    for array in (pa.array(texts, pa.string()), pa.array(["q q", *texts, "r"], pa.string()).slice(1, len(texts))):
        words, lengths = suffix_tree._words(array)
        assert lengths.tolist() == [len(ws) for ws in plain] and [w.encode() for w in words.to_pylist()] == [w for ws in plain for w in ws]
    assert len(suffix_tree._words(pa.array([], pa.string()))[1]) == 0


def test_unlisted_successors_pass_no_python_function(spark):
    docs, _ = corpus(spark)
    tree, _ = suffix_tree.train(docs.select("text"), 3, 0.003, 0.004, 0.003, 0.02, whole=True)
    for k, rest in enumerate(tree.rest):
        level, wanted = tree.levels[k], np.arange(len(tree.levels[k].totals)) % 2 == 0
        settled = suffix_tree._settled(rest, tree, k + 1, 7, wanted)
        plan = settled._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "MapInArrow" not in plan
        expected = {}
        for r in rest.collect():
            context = r.key // tree.slots
            left = level.kept[context] * r.parent
            p = (r.n - suffix_tree.DISCOUNT) / level.totals[context] + left if level.kept[context] < 1 else r.parent
            if wanted[context]:
                expected[r.key + 7, r.name] = pytest.approx((p, math.log10(p / left)))
        assert {(r.key, r.name): (r.p, r.more) for r in settled.collect()} == expected != {}
    option = spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")
    assert option in ("0", "0b")  # set while the operator runs only


def names_of(contexts, key, tree):
    return (*contexts[key // len(tree.words)], tree.words[key % len(tree.words)])
