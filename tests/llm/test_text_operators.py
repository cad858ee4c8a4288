"""Operators over documents against plain Python over the same rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from skeinframe.llm import blocks, decontamination, license_scan, near_dedup, ngram_lm, quality_rules, substring_dedup

SCHEMA = "doc_id long, text string, lang string, extra string, key string, block long"
BENCH = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, empty and null texts, repeated and null ids."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdéß日") for _ in range(r.randint(1, 6))) for _ in range(300)] + ["The", "the", "#a$", "%%"]
    passage = [r.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(n):
        body = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 40, 120, 300]))]
        if i % 5 == 0:
            at = r.randint(0, len(body))
            body[at:at] = passage[: r.choice([49, 50, 70])]
        if i % 9 == 0:
            body += body[:30]
        text = "".join(w + r.choice([" ", "\n", "  ", "\t"]) for w in body)
        rows.append([i, text])
    for i in range(12):
        rows.append([n + i, rows[r.randrange(n)][1]])
    rows += [[n + 20, None], [n + 21, ""], [n + 22, " \n\t "], [None, rows[3][1]], [None, None], [5, rows[5][1]], [5, rows[0][1]]]
    r.shuffle(rows)
    return [(i, t, r.choice(["en", "de", None]), "x", "y", 1) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(3)


def expected_dedup(rows, window=50):
    least = defaultdict(lambda: math.inf)
    split = [(math.inf if i is None else i, words(t)) for i, t, *_ in rows]
    for i, w in split:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            least[k] = min(least[k], i)
    out = []
    for (i, w), row in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((row[0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(docs, rows):
    found = substring_dedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected_dedup(rows)
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(words(r.kept_text)) == r.n_words - r.n_removed
    assert sum(r.n_removed for r in found) > 500


@pytest.mark.parametrize("group_bytes", [64, 16 * 64, 3 * 16 * 64])
def test_substring_dedup_prefix_lengths(docs, rows, monkeypatch, group_bytes):
    """Prefixes of 8, 15, 22 and 50 words, by how many documents share an anchor."""
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group_bytes)
    found = substring_dedup.dedup(docs, texts=False).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected_dedup(rows)


def test_suffix_order_and_common_depth():
    r = np.random.default_rng(5)
    prefix = np.sort(r.integers(0, 3, 300).astype(np.uint64))
    edges = r.integers(0, 2, (300, 6)).astype(np.uint32)
    order, common = substring_dedup.suffix_order(prefix, edges)
    want = sorted((int(p), *map(int, e)) for p, e in zip(prefix, edges, strict=True))
    assert [(int(prefix[i]), *map(int, edges[i])) for i in order] == want
    for a, b, depth in zip(want, want[1:], common.tolist(), strict=False):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 7)
        assert depth == n - 1


@pytest.mark.parametrize("ask", [lambda n: substring_dedup.leaf_question(50, n), near_dedup.ask_frequencies])
def test_a_block_sends_a_common_text_once(spark, ask):
    """One text in half of all rows: owners get one row of it for each block, not one for each document."""
    rows = [(i, " ".join(f"w{j}" for j in range(60)) if i % 2 else " ".join(f"u{i}x{j}" for j in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sent = blocks.ask(blocks.blocks(docs, blocks.split_words), ask(2)).collect()
    n_blocks = len({r.block for r in sent})
    texts = sum(len(np.frombuffer(blocks.unpack_parts(r.payload)[3], np.int64)) for r in sent)
    assert texts <= 200 + n_blocks


def test_substring_dedup_very_long_text(spark):
    r = random.Random(7)
    long = [r.choice(["ab", "cd", "é", "xyz"]) + str(r.randrange(10**6)) for _ in range(120_000)]
    rows = [(1, " ".join(long[50_000:50_070])), (2, " ".join(long)), (3, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup(docs, texts=False).collect()}
    assert got == {1: (70, 0), 2: (120_000, 70), 3: (1, 0)}


def test_substring_dedup_windows_of_any_block_size(docs, rows, monkeypatch):
    monkeypatch.setattr("skeinframe.llm.blocks.BLOCK_TOKENS", 700)
    found = substring_dedup.dedup(docs, texts=False).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected_dedup(rows)


def expected_measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if many[x] > 1:
            covered |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_rules.verdicts(docs, labels).collect()
    want = Counter()
    for i, t, *_ in rows:
        m = expected_measures(t)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want[(i, *m, failed, not failed)] += 1  # so few labels certify no cutoff
    assert Counter(tuple(r) for r in found) == want
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(v for k, v in want.items() if k[-1])


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(k, n) for n in (1, 7, 100, 700, 3000) for k in (0, 1, 3, 8, 25) if k <= n * 0.01]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect()
    for r in rows:
        assert r.p == pytest.approx(binomial_tail(r.k, r.n, 0.01), rel=1e-8)


def base_fails(t):
    m = expected_measures(t)
    return m[0] < 20 or 100 * m[4] > 30 * m[0]


def rule_ratios(t):
    n, chars, symbols, dup, repeat = expected_measures(t)
    lines = [s for s in t.split("\n") if words(s)]
    loud = sum(x == "!" or "A" <= x <= "Z" for x in t)
    return {"symbols": symbols / max(n, 1), "loud": loud / max(chars, 1), "dup_lines": dup / max(len(lines), 1), "repeats": repeat / max(n, 1), "word_length": chars / max(n, 1)}


def sides(spark, texts):
    """{text: True for the part that chooses, False for the holdout}."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(t,) for t in set(texts)], "text string")
    return dict(frame.select("text", quality_rules.chooses(F.col("text"))).toPandas().itertuples(index=False, name=None))


def test_levels_stop_where_good_documents_of_the_holdout_would_go(spark):
    """A tenth of the holdout's good documents are half capitals; no document of the part that chooses shows it."""
    loud = lambda i, every: " ".join(("ABCDEFGH" if j % every == 0 else "abcdefgh") + f"{i:04}{j:02}" for j in range(30))
    texts = {i: loud(i, 2 if i % 10 == 0 else 99) for i in range(600)}
    on = sides(spark, texts.values())
    good = {i: t for i, t in texts.items() if i % 10 or not on[t]}
    bad = {1000 + i: loud(1000 + i, 1 + i % 2) for i in range(60)}  # one half as loud as the good ones
    few = {2000 + i: loud(2000 + i, 99) for i in range(50)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in (good | bad).items()] + [(i, t, "de") for i, t in few.items()], "doc_id long, text string, lang string")
    labelled = spark.createDataFrame([(i, int(i not in bad), 0) for i in [*good, *bad, *few]], "doc_id long, quality int, toxic int")
    half = [rule_ratios(t)["loud"] for i, t in good.items() if i % 10 == 0]
    held = [t for t in good.values() if not on[t]]
    assert 0.07 < len(half) / len(held) < 0.13
    grid = quality_rules.GRIDS["loud"]
    wanted = max(j for j, x in enumerate(grid) if x >= max(half))  # the last level that lets half capitals pass
    caught = [sum(rule_ratios(t)["loud"] > x for t in bad.values()) for x in grid]
    assert caught[wanted] < caught[-1], "the part that chooses must want more than the holdout allows"
    found = quality_rules.certified_levels(docs, labelled).collect()
    assert [x.stratum for x in found] == ["=en"]
    side = sides(spark, bad.values())
    bad_held = [t for t in bad.values() if not side[t]]
    for x in found:
        assert tuple(x)[1:4] == (wanted, len(held), 0) and (x.n_bad, x.n_bad_rejected) == (len(bad_held), sum(rule_ratios(t)["loud"] > grid[wanted] for t in bad_held))
    kept = {x.doc_id for x in quality_rules.verdicts(docs, labelled).where("kept").collect()}
    assert kept >= {*good, *few}


def test_without_bad_labels_the_strictest_allowed_level_is_tested(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(400)], "doc_id long, text string, lang string")
    labelled = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    on = sides(spark, [x.text for x in docs.collect()])
    found = [tuple(x)[:4] for x in quality_rules.certified_levels(docs, labelled).collect()]
    assert found == [("=en", quality_rules.LEVELS - 1, sum(not x for x in on.values()), 0)]
    assert quality_rules.keep_good(docs, labelled).count() == 400


def test_quality_very_long_text_and_empty_tables(spark):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(60_000)) + "\n" + "x" * 200_000
    docs = spark.createDataFrame([(1, long, "en"), (1, None, None)], "doc_id long, text string, lang string")
    labelled = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.n_words: tuple(r)[1:6] for r in quality_rules.verdicts(docs, labelled).collect()}
    assert got == {60_001: tuple(expected_measures(long)), 0: (0, 0, 0, 0, 0)}
    none = docs.where("false")
    assert quality_rules.verdicts(none, labelled).count() == 0 and quality_rules.keep_good(none, labelled).count() == 0
    assert quality_rules.verdicts(docs, labelled.where("false")).count() == 2


def test_certified_cutoffs_keep_the_promise(spark):
    """Of good documents 0.1 % have many symbols, so cutoffs below their ratio can be certified, and bad ones are caught."""
    r = random.Random(3)
    texts, labels = [], []
    for i in range(6000):
        good = i % 4 > 0
        noisy = r.random() < (0.001 if good else 0.9)
        w = [r.choice("abcdefghij") * r.randint(2, 6) + ("#%" if noisy else "") for _ in range(30)]
        texts.append((i, " ".join(w), "en" if i % 2 else None))
        labels.append((i, int(good), 0))
    docs, labelled = spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cut = {(x.stratum, x.rule): x for x in quality_rules.certified_cutoffs(docs, labelled).collect()}
    assert cut[("=en", "symbols")].cutoff < 2 and cut[("null", "symbols")].cutoff < 2
    levels = {x.stratum: x for x in quality_rules.certified_levels(docs, labelled).collect()}
    on = sides(spark, [t for _, t, _ in texts])
    for name, lang in (("=en", "en"), ("null", None)):
        mine = [(on[t], q, rule_ratios(t)) for (_, t, k), (_, q, _) in zip(texts, labels, strict=True) if k == lang and not base_fails(t)]
        gone = lambda choosing, q, j: sum(any(x[r] > grid[j] for r, grid in quality_rules.GRIDS.items()) for c, g, x in mine if (c, g) == (choosing, q))  # noqa: E731, B023
        size = lambda choosing, q: sum((c, g) == (choosing, q) for c, g, _ in mine)  # noqa: E731, B023
        allowed = [j for j in range(quality_rules.LEVELS) if gone(True, 1, j) <= 0.05 * size(True, 1)]
        chosen = max(allowed, key=lambda j: (gone(True, 0, j), -j if gone(True, 0, max(allowed)) else j))
        taken = []
        for j in range(chosen + 1):
            if binomial_tail(gone(False, 1, j), size(False, 1), 0.05) > 0.05 / 2:
                break
            taken.append((j, size(False, 1), gone(False, 1, j)))
        x = levels[name]
        assert tuple(x)[1:4] == taken[-1] and x.p_value == pytest.approx(binomial_tail(x.n_rejected, x.n_good, 0.05), rel=1e-8)
        assert (x.n_bad, x.n_bad_rejected) == (size(False, 0), gone(False, 0, x.level))
    found = {x.doc_id: x.kept for x in quality_rules.verdicts(docs, labelled).collect()}
    assert sum(not found[i] for i, good, _ in labels if good) <= 0.05 * 4500
    assert sum(not found[i] for i, good, _ in labels if not good) > 0.8 * 1500


def expected_scores(rows, order, mu):
    """Token by token through dicts: a state is the longest history that training had."""
    texts = [[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(t)] + [None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    count = Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            count.update(tuple(t[i : i + n]) for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total, distinct = sum(v for k, v in count.items() if len(k) == 1), sum(len(k) == 1 for k in count)

    def p(history, w):
        if not history:
            return (count[(w,)] + 1) / (total + distinct + 1)
        return (count[(*history, w)] + mu * p(history[1:], w)) / (count[history] + mu)

    out = []
    for (i, *_), t, h in zip(rows, texts, held, strict=True):
        base, score, state = 0.0, 0.0, ()
        for w in t:
            base += math.log10(p((), w))
            while True:
                if not state or count[(*state, w)]:
                    score += math.log10(p(state, w))
                    break
                score += math.log10(mu / (count[state] + mu))
                state = state[1:]
            state = (*state, w)[-(order - 1) :] if order > 1 else ()
            while state and not count[state]:
                state = state[1:]
        out.append((i, h, len(t), sum(count[(w,)] > 0 for w in t), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_ngram_scores(docs, rows, order, monkeypatch):
    monkeypatch.setattr("skeinframe.llm.blocks.BLOCK_TOKENS", 2000)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    found = sorted((tuple(r) for r in ngram_lm.scores(docs, order=order, mu=2.0).collect()), key=key)
    for a, b in zip(found, sorted(expected_scores(rows, order, 2.0), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_decontamination(spark, docs, rows):
    texts = [t for _, t, *_ in rows if t and len(words(t)) > 30]
    items = [(1, " ".join(words(texts[0])[5:25])), (2, " ".join(words(texts[1])[:40]).upper()), (3, "one two three four"), (4, None), (None, "a b c d e f g"), (5, "never seen words here at all my friend"), (6, "")]
    bench = spark.createDataFrame(items, BENCH)
    plain = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [plain(t)] for i in range(len(w) - 4)}
    pooled = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            pooled[i] |= shingles(t)
    want = {(i, j, len(s), len(s & d), len(s & d) / len(s)) for i, d in pooled.items() for j, t in items if j is not None and (s := shingles(t)) and len(s & d) >= 0.8 * len(s)}
    assert want and {tuple(r) for r in decontamination.contained(docs, bench).collect()} == want
    left = decontamination.without_leaks(docs, bench)
    assert left.columns == docs.columns
    leaked = {w[0] for w in want}
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, *_ in rows if i not in leaked)


def test_license_scan(spark):
    mit = license_scan.KNOWN["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.replace(" ", "  ").upper(), "a"),
        (2, "text\nLicenced under CC BY-NC 4.0\nreleased under the mit license!", "a"),
        (3, "Released under the MIT Licence.", "a"),
        (4, None, "a"), (5, "", "a"), (None, mit, "a"), (6, mit + " and more", "a"), (6, "nothing", "a"),
    ]
    found = sorted(((r.doc_id or 0, r.licence, r.line_licences) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string")).collect()), key=str)
    assert found == sorted([(1, "MIT", ""), (2, None, "notice: CC-BY-NC-4.0,notice: MIT"), (3, "notice: MIT", "notice: MIT"), (4, None, ""), (5, None, ""), (0, "MIT", ""), (6, None, ""), (6, None, "")], key=str)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], BENCH)
    assert substring_dedup.dedup(none).count() == 0
    assert quality_rules.verdicts(none, labels).count() == 0
    assert ngram_lm.scores(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert decontamination.contained(none, bench).count() == 0
    assert decontamination.contained(docs, bench).count() == 0
    assert decontamination.without_leaks(docs, bench).count() == docs.count()
