import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logtables.llm import packing, quality, tokens
from tests.llm import fixtures

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_counts(spark):
    found = quality.quality_rules(fixtures.frame(spark)).collect()
    assert len(found) == len(fixtures.rows())
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(r.text)
        assert not (r.base_failed and r.kept)
    texts = {r.text for r in quality.keep_good(fixtures.frame(spark)).collect()}
    assert fixtures.prose(1, 300) in texts and fixtures.prose(3, 5000) in texts and "one two" not in texts
    assert quality.keep_good(fixtures.frame(spark)).columns == fixtures.frame(spark).columns
    assert quality.quality_rules(fixtures.frame(spark, [])).count() == 0


def planted(size):
    """Of about twice ``size`` bytes, all passing the base rules: prose, repetitive text, incompressible text."""
    rng = random.Random(size)
    # Numbered words differ from one another, so no window repeats.
    numbered = "\n".join(f"entry{k} value{k} was{k} seen{k}" for k in range(size // 20))
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=9)) for _ in range(size // 5 + 50))
    return fixtures.prose(size, size // 3), numbered, noise


@pytest.mark.parametrize("size", [1024, 2048, 4096, 8192, 16384, 65536, 200_000])
def test_bands_decide(size):
    compressor = quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    found = [quality.measure(t, compressor)[5:7] for t in planted(size)]
    assert found == [(False, True), (False, False), (False, False)]


def test_chunks_cover_the_text_and_decide():
    compressor = quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    for n in (0, 1, 4095, 4096, 4097, 5119, 5120, 5121, 20_000):
        raw = fixtures.prose(4, n).encode()[:n]
        parts = quality.chunks_of(raw)
        assert b"".join(parts) == raw and all(1024 <= len(p) < 5120 for p in parts[1:]) and len(parts) == max(n // 4096 + (n % 4096 >= 1024 or 0 < n < 4096), n > 0)
    # Prose around noise: the whole is within its band, two of five chunks are not.
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=9)) for _ in range(900))
    mixed = fixtures.prose(1, 2200)[:12_000] + " " + noise
    found = quality.measure(mixed, compressor)
    assert found[6] is False and found[9] >= 2 and quality.in_band(len(mixed.encode()), found[7], quality.BANDS) and not found[5]


def test_fitted_bands(spark):
    texts = [fixtures.prose(k, 60 + 7 * k % 900) for k in range(300)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts, None, "", "x"]], "text string").repartition(3)
    bands = quality.fit_bands(docs)
    assert [b[0] for b in bands] == [b[0] for b in quality.BANDS] and bands[-1] == quality.BANDS[-1]
    compressor = quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    ratios = [(len(t.encode()), quality.measure(t, compressor)) for t in texts]
    assert all(quality.in_band(n, m[7], bands) for n, m in ratios if not m[5])
    inside = [m[7] for n, m in ratios if 1024 <= n < 2048 and not m[5]]
    assert bands[2][1] == pytest.approx(min(inside) * 0.75, rel=0.05) and bands[2][2] == pytest.approx(max(inside) * 1.2, rel=0.05)
    assert quality.fit_bands(docs.where("false")) == quality.BANDS


@pytest.mark.parametrize("text", [
    "", " ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a  \nb", "  a b", "don't stop  \t x", "é 😀  z", "<|endoftext|> x", "a  b", "a  b",
    "x\x1c y", "1 22 333,4", "tab\t\tb c",
])
def test_encoding_is_the_tokenizers(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.encode(text, PATH) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_random_texts_have_the_ids_of_the_tokenizer_as_loaded(tokenizer):
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "\t ", "'s", "'LL", "a", "é", "😀", "1", "22", ".", "\x1c", "\x85", "\u00a0", "the", "ſ", "ing", "\u3000", "Don't"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(8000)] + ["x" * 100_000, " " * 50_000 + "x"]
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert tokens.encode(text, PATH) == b"".join(i.to_bytes(4, "little") for i in found.ids), text
    assert tokens.encode("x <|endoftext|> y", PATH) == b"".join(i.to_bytes(4, "little") for i in (87, 220, 50256, 331))


def test_files_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        tokens.encode("x", public_tokenizers.path("word_bpe_49k.json"))


def test_histogram(spark, tokenizer):
    lengths = Counter(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in fixtures.rows())
    histogram = tokens.length_histogram(tokens.token_lengths(fixtures.frame(spark))).cache()
    found = {r.length: r for r in histogram.collect()}
    assert {k: r.n_docs for k, r in found.items()} == lengths
    for n, r in found.items():
        assert r.docs_from == sum(c for k, c in lengths.items() if k >= n) and r.docs_below == sum(lengths.values()) - r.docs_from
        assert r.tokens_from == sum(k * c for k, c in lengths.items() if k >= n)
        assert r.truncated_tokens == sum(min(k, n) * c for k, c in lengths.items())
    limit = 700
    assert tokens.totals_at(histogram, limit).first().truncated_tokens == sum(min(k, limit) * c for k, c in lengths.items())
    every = sorted(k for k, c in lengths.items() for _ in range(c))
    assert tokens.quantile(histogram, 0.5).first().length == every[-(-len(every) // 2) - 1]
    assert tokens.length_histogram(spark.createDataFrame([(None,)], "n_tokens long")).count() == 0


def test_packing(spark, tokenizer):
    found = [r for r in packing.pack(fixtures.frame(spark)).collect()]
    wanted = Counter()
    for r in fixtures.rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            data = b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])
            wanted[r[0], piece, start, length, packing.zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(fixtures.frame(spark, [])).count() == 0


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_is_that_of_a_plain_model():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    packer, bins, used = packing.Packer(100, 8, 0), {}, {}
    for n in lengths:
        fit = min((f for f in bins.values() if f >= n), default=None)
        where, offset = packer.place(n)
        assert offset == used.get(where, 0)
        used[where] = offset + n
        if fit is None:
            assert where not in bins
            bins[where] = 100 - n
        else:
            assert bins[where] == fit
            bins[where] -= n
        if not bins[where]:
            del bins[where]
        if len(bins) > 8:
            fullest = min(bins.values())
            open_now = {b for free in packer.by_free for b in free}
            gone = [b for b in bins if b not in open_now]
            assert len(gone) == 1 and bins[gone[0]] == fullest
            del bins[gone[0]]
    assert max(used.values()) <= 100
