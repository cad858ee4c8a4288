"""Phrase mining against plain Python over the same rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from skeinframe.llm import phrase_mining as pm

SCHEMA = "doc_id long, text string, lang string, rank long, part int, id long"


def corpus(seed=2, n=80):
    """Texts of few words with shared phrases, all kinds of breaks, null texts and languages, copies, other scripts."""
    r = random.Random(seed)
    vocabulary = ["The", "the", "é", "É", "a", "b", "c\x1fd", "日本", "x-y", "\x00", "ÿ"]
    phrases = ["red green blue", "one two three four five six", "New York", "a a a a"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.choice([0, 1, 8, 60])):
            words += r.choice(phrases).split() if r.random() < 0.3 else [r.choice(vocabulary)]
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\r", "\x0b", "\x0c", "?!"]) for w in words)
        rows.append((i, r.choice([text, text, text, text, None]), r.choice(["en", "en", "en", "de", None, "und"]), 1, 1, 1))
    rows += [rows[3]] * 15
    r.shuffle(rows)
    return rows


def expected(rows, longest=5, least=3, share=100, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        kept = {p: a for p, a in count.items() if 2 <= len(p) and a >= least}
        found = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("block,tile,most,share", [(1 << 20, (64, 1024), 2000, 100), (200, (2, 8), 7, 100), (1, (4, 4), 2000, 60)])
def test_mining_equals_brute_force(spark, monkeypatch, block, tile, most, share):
    rows = corpus()
    monkeypatch.setattr(pm, "BLOCK_WORDS", block)
    monkeypatch.setattr(pm, "NARROWEST", tile[0])
    monkeypatch.setattr(pm, "WIDEST", tile[1])
    want = expected(rows, least=3, most=most, share=share)
    assert len(want) > 15
    assert got(pm.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), least=3, most=most, share=share)) == want


def test_mining_a_very_long_text_and_a_hot_language(spark):
    r = random.Random(1)
    long = " ".join(r.choice(["to be", "or not", "x", "y", "z"]) for _ in range(200_000))
    rows = [(1, long, "en", 1, 1, 1), (2, "to be or not " * 50, "de", 1, 1, 1)]
    assert got(pm.mine(spark.createDataFrame(rows, SCHEMA), least=40)) == expected(rows, least=40)


def test_mining_nothing(spark):
    for rows in ([], [(1, None, None, 1, 1, 1), (2, "", "en", 1, 1, 1), (3, "a b", "en", 1, 1, 1)]):
        assert pm.mine(spark.createDataFrame(rows, SCHEMA), least=2).count() == 0


def test_dense_and_sorted_counts_agree():
    r = np.random.default_rng(3)
    ids = (r.pareto(0.6, 20_000) * 20).astype(np.int64).clip(0, 60_000).astype(np.uint32)
    pairs = pm.pairs_of(ids)[:-1]
    weights = r.integers(1, 9, len(pairs))
    tiles = np.unique(pm.tile_of(pairs), return_counts=True)
    assert (tiles[1] * pm.DENSE >= pm.NARROWEST**2).any() and (tiles[1] == 1).any()
    for w in (None, weights):
        for a, b in zip(pm.count_pairs(pairs, w), pm.sorted_counts(pairs, w), strict=True):
            assert (a == b).all()
    b = pm.band(np.arange(10_000))
    assert (pm.band_start(b) <= np.arange(10_000)).all() and (np.arange(10_000) < pm.band_start(b) + pm.band_width(b)).all()


def test_scores_beyond_64_bits(spark):
    """a * n passes 64 bits; the quotient is exact."""
    big = 3_037_000_499_123
    df = spark.createDataFrame([(big, big + 5, [big - 2], [big - 7])], "a long, n long, before array<long>, after array<long>")
    assert df.select(pm.lowest_cut(2).alias("x")).first().x.score == 1000 * big * (big + 5) // ((big - 2) * (big - 7))
