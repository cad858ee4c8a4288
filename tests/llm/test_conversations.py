"""Chat formatting and the prefix trie against plain Python over the same rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from skeinframe.llm import chat_format, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, example long, part string, extra int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talks(seed=3, n=40):
    """Conversations with null and equal turns, null texts and roles, repeated rows, control strings and a null id."""
    r = random.Random(seed)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "</\\s>", "<\\\\/s>", "[\\INST]", "[", "<", "\\", "s>", "INST]", "é日", " ", "\n", "ok"]
    rows = []
    for c in [*range(n), None]:
        for t in range(r.choice([1, 2, 5, 9])):
            text = None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
            rows.append((c, r.choice([None, t, t, 1]), r.choice(["user", "assistant", "system", None, "", "</s>", "a[INST]"]), text))
    rows += r.sample(rows, 10)
    r.shuffle(rows)
    return [(*x, 7, "clash", 1) for x in rows]


def in_order(rows):
    found = defaultdict(list)
    for c, t, role, text, *_ in rows:
        found[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in found.items()}


def expected_back(rows):
    out = {}
    for c, turns in in_order(rows).items():
        loss = "".join(t for role, t in turns if role == "assistant")
        at, chars, n = 3, 0, 0
        for k, (role, text) in enumerate(turns):
            at += 17 + len(chat_format.escaped(role)) + len(chat_format.escaped(text))
            if role == "assistant" or k == len(turns) - 1:
                chars, n = chars + at, n + 1
        out[c] = (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), chars, n)
    return out


def test_escaping_is_reversible_and_leaves_no_mark():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("<[\\/s>INST]") for _ in range(r.randint(0, 14)))
        inside = chat_format.escaped(text)
        assert chat_format.unescaped(inside) == text and not chat_format.MARKS.search(inside)
    seen = {chat_format.escaped(t) for t in ("<s>", "<\\s>", "<\\\\s>")}
    assert len(seen) == 3


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 16])
def test_read_back_equals_the_turns(spark, part):
    rows = talks()
    made = chat_format.examples(spark.createDataFrame(rows, SCHEMA), part)
    for back in (chat_format.read_back(made, in_order=True), chat_format.read_back(spark.createDataFrame(made.orderBy("text").collect(), chat_format.EXAMPLES))):
        assert {r.conv_id: tuple(r)[1:] for r in back.collect()} == expected_back(rows)


def test_whole_examples_hold_all_preceding_turns(spark):
    rows = talks(5)
    want = []
    for c, turns in in_order(rows).items():
        text, e = chat_format.OPEN, 0
        for k, (role, body) in enumerate(turns):
            before = f"{text}[INST]{chat_format.escaped(role)}[/INST]"
            text = f"{before}{chat_format.escaped(body)}</s>"
            if role == "assistant" or k == len(turns) - 1:
                span = (len(before), len(text) - 4) if role == "assistant" else (None, None)
                want.append((c, e, k + 1, text, *span))
                e += 1
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for part in (9, 1 << 16):
        got = chat_format.whole_texts(chat_format.examples(spark.createDataFrame(rows, SCHEMA), part)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_long_conversations_and_texts_stay_linear(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(1000)] + [(2, 0, "assistant", "</s>x" * 400_000)]
    made = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1 << 12).cache()
    total = sum(len(r[3]) for r in rows)
    assert made.selectExpr("sum(length(text))").first()[0] < 25 * total
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert back[1].loss_chars == sum(len(r[3]) for r in rows[:1000] if r[1] % 2) and back[1].n_turns == 1000
    assert back[2].loss_chars == 2_000_000 and back[2].loss_sha256 == sha("</s>x" * 400_000)


def test_formatting_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_format.read_back(chat_format.examples(empty)).count() == 0
    assert chat_format.whole_texts(chat_format.examples(empty)).count() == 0


def expected_nodes(rows, graft=True):
    """The trie by brute force: every beginning of every rebuilt conversation as a tuple of turns."""
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if graft else 0
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, got in members.items():
        mine = (len(got) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += mine
            leaves[node[:d]] += not children[node]
    return sorted(
        (min(v), len(k), min(members[k[:-1]]) if k else -1, len(v), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, [])))))) for k, v in members.items()
    )


def got_nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def trees(seed=4, n=300):
    """Conversations of few different turns, copies of one, repeated rows and gaps in the ids."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(n * 2), n):
        kind = r.random()
        if kind < 0.3:
            turns = [("user", "same"), ("assistant", "é" * 5), ("user", "end")]
        else:
            turns = [(r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "cc"])) for _ in range(r.choice([1, 2, 4, 7, 12]))]
        rows += [(c, r.choice([t, t, t, None]), *x, 1, "p", 2) for t, x in enumerate(turns)]
    rows += r.sample(rows, 20) + [(None, 0, "user", "x", 1, "p", 2)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns,deepest", [(10**6, 64), (150, 64), (20, 64), (20, 2), (5, 1)])
@pytest.mark.parametrize("graft", [True, False])
def test_trie_equals_brute_force(spark, shard_turns, deepest, graft):
    rows = trees()
    found = prefix_trie.paths(spark.createDataFrame(rows, SCHEMA), near=5)
    found = prefix_trie.grafted(found) if graft else found
    assert got_nodes(prefix_trie.nodes(found, shard_turns, deepest)) == expected_nodes(rows, graft)


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    """Half of all conversations are copies, so splitters fall among them; one conversation is long."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 600, 2) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(1, 600, 2)]
    long = [(1000, t, "user", f"long {t}") for t in range(5000)]
    df = spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string")
    got = got_nodes(prefix_trie.nodes(prefix_trie.grafted(prefix_trie.paths(df, near=5)), 200, 64))
    want = expected_nodes(rows)  # without the long one, as brute force takes the square of its length
    assert sum(x[0] == 1000 and x[3] == 1 and x[6] == 0 for x in got) == 5000 and max(x[1] for x in got) == 5000
    assert [x for x in got if x[0] != 1000 and x[1]] == [x for x in want if x[1]]
    root, want_root = (next(x for x in y if x[1] == 0) for y in (got, want))
    assert root[3] == want_root[3] + 1 and root[5] == want_root[5] + 1


def test_trie_without_rows(spark):
    assert prefix_trie.nodes(prefix_trie.grafted(prefix_trie.paths(spark.createDataFrame([], SCHEMA), near=5))).count() == 0
