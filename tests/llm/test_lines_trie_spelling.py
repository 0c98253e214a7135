"""Line dedup, the conversation trie and spelling variants against brute force, on small tables full of hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from shelfspark.llm import lines, spelling, trie
from shelfspark.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines int, kept int, key string, word string"


def crc(text):
    return zlib.crc32(text.encode())


# Lines


def brute_lines(texts, min_docs, least=1):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    split = [(t or "").split("\n") for t in texts]
    docs = Counter(k for s in split for k in {key(x) for x in s} if len(k) >= least)
    out = []
    for s in split:
        stay = [x for x in s if docs[key(x)] < min_docs]
        out.append((len(s), len(s) - len(stay), "\n".join(stay)))
    return out


def line_texts():
    rng = random.Random(2)
    pool = ["Share This", "share this ", "\tSHARE THIS\x0b", "É a", "é a", "x", "", "  ", "日本", "日本 "] + [f"line {i}" for i in range(30)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    long = "\n".join(f"own {i % 700} {i}" for i in range(4000)) + "\nshare this\nline 3"
    return texts + [None, "", "\n\n", "share this\nshare this", texts[0], texts[0], long, "word " * 40_000 + "\r\nline 4"]


@pytest.mark.parametrize("least", [1, 3])
def test_lines_of_many_documents_go_as_by_brute_force(spark, least):
    texts = line_texts()
    docs = spark.createDataFrame([(i if i != 5 else None, t, 7, 8, "k", "w") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    shared = lines.shared_lines(spark, [docs.where("doc_id % 3 = 0 or doc_id is null"), docs.where("doc_id % 3 = 1"), docs.where("doc_id % 3 = 2")], min_docs=6, least=least)
    found = lines.drop_lines(docs, shared, least)
    assert found.columns == ["doc_id", "text", "key", "word", "n_lines", "n_dropped", "kept"]
    got = Counter((r.text, r.n_lines, r.n_dropped, r.kept) for r in found.collect())
    assert got == Counter((t, *x) for t, x in zip(texts, brute_lines(texts, 6, least)))


def test_lines_beyond_the_head_are_matched_by_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lines, "HEAD", 2)
    texts = line_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.kept) for r in lines.drop_lines(docs, lines.shared_lines(spark, [docs], 4)).collect())
    assert got == [(i, x[2]) for i, x in enumerate(brute_lines(texts, 4))]


def test_runs_are_compacted_and_count_over_all_batches(spark):
    runs = lines.LineRuns(spark, fanout=2, buckets=2)
    batches = [["a\nb", "a"], ["a\nc", "d"], ["b", "a"], ["a\nb\nb"], ["c\nd\ne"]]
    for batch in batches:
        runs.add(lines.line_counts(spark.createDataFrame([(t,) for t in batch], "text string")), at_least=3)
    assert runs.runs == [1, 0, 1]
    plan = runs.unseen(runs.levels()[0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan  # a run meets another without moving
    got = {bytes(r.key) for r in runs.counted(3).collect()}
    assert got == {lines.line_key(b"a", 1), lines.line_key(b"b", 1)}
    runs.close()
    assert not runs.levels()


def test_settled_keys_do_not_come_in_again(spark):
    runs = lines.LineRuns(spark, fanout=9, buckets=2)
    docs = spark.createDataFrame([("hot",)] * 5, "text string")
    for _ in range(2):
        runs.add(lines.line_counts(docs), at_least=4)
    assert runs.runs == [2] and runs.levels()[0].count() == 1
    assert runs.counted(4).count() == 1
    runs.close()


def test_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_lines(docs, lines.shared_lines(spark, [docs])).collect() == []
    assert lines.drop_lines(docs, lines.shared_lines(spark, [])).collect() == []


def test_batches_of_a_table_are_its_files(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "t"))
    parts = lines.batches_of(spark.read.parquet(str(tmp_path / "t")), 3)
    assert len(parts) == 3 and sorted(r.id for p in parts for r in p.collect()) == list(range(100))
    assert len(lines.batches_of(spark.range(3).toDF("id"), 3)) == 1


# Conversations


def brute_trie(turns, every=20, heads=4):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    new = {}
    for c in own:
        h = crc(str(c)) % heads
        new[c] = own.get(int(c / every) * every, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(convs) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def conversation_rows():
    rng = random.Random(3)
    texts = ["hello there", "how are you", "", None, "one two three four", "naïve\x0bword", "x " * 3000]
    rows = []
    for c in range(130):
        if c in (20, 60):
            continue
        if c % 3 == 0:  # a third are copies of one conversation
            rows += [(c, t, "user" if t % 2 else None, f"copy {t}") for t in range(5)]
        else:
            rows += [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.randrange(1, 7))]
    rows += [(500, t, "user", f"long {t % 3}") for t in range(600)] + [(520, t, "user", f"long {t % 3}") for t in range(590)]
    rows += [(None, 0, "user", "lost"), (141, 0, "user", "only"), (-7, 0, "user", "copy 0"), (10**12, 3, "user", "copy 0")]
    return rows


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 100_000])
def test_trie_is_the_brute_force_trie_however_it_is_cut(spark, shard_turns, monkeypatch):
    monkeypatch.setattr(trie, "_IDS", 3)
    rows = conversation_rows()
    rng = random.Random(1)
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie_rows(trie.trie(trie.rebuild(trie.sequences(turns)), shard_turns))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_trie(rows)


def test_turns_of_equal_number_have_a_fixed_order(spark):
    rows = [(1, 0, "user", t) for t in "abcab"]
    found = [trie_rows(trie.trie(trie.sequences(spark.createDataFrame(r, "conv_id long, turn long, role string, text string")))) for r in (rows, rows[::-1])]
    assert found[0] == found[1] and len(found[0]) == 6


def test_trie_of_no_conversations_has_no_root(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.rebuild(trie.sequences(nothing))).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.rebuild(trie.sequences(lost))).collect() == []


def test_median_insertion_makes_a_balanced_tree():
    tree = trie.SearchTree()
    for i in trie.by_median(1023):
        tree.insert([i], i)
    assert sorted(trie.by_median(1023)) == list(range(1023))
    depth, stack = 0, [(tree.equal[0], 1)]
    while stack:
        at, d = stack.pop()
        if at:
            depth = max(depth, d)
            stack += [(tree.low[at], d + 1), (tree.high[at], d + 1)]
    assert depth == 10
    assert [tree.symbol[n] for n in tree.walk()][1:] == list(range(1023))


# Spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_counts(docs, every=199):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc(f"{'' if doc is None else doc}:{run}")
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return n


def brute_forms(counts, least_n=5, times=5):
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_n}
    form, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        out[w] = len(near)
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def spelling_docs():
    rng = random.Random(8)
    base = ["banana", "bananas", "bananna", "letters", "lettters", "Straße", "naïveté", "naivete", "ÀÉÎÕÜß", "aaaaaa", "aaaaaaa", "aaaaaaaa", "mississippi", "short", "÷×abcdef", "z" * 3000, "z" * 2999]
    weights = [400, 60, 9, 200, 30, 40, 90, 12, 20, 6, 40, 300, 50, 100, 20, 7, 6]
    pool = [w for w, n in zip(base, weights) for _ in range(n)]
    docs = [(i, " ".join(rng.choice(pool) if rng.random() < 0.9 else rng.choice(pool).upper() for _ in range(40)) + rng.choice([" a1b2", "\n", "_banana_"])) for i in range(80)]
    return docs + [(None, "banana " * 7), (3, None), (4, ""), docs[0], docs[0], (10**11, "日本語 bananas")]


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_spelling_forms_are_those_of_brute_force(spark, symbols):
    docs = spelling_docs()
    table = spark.createDataFrame([(d, t, 1, 2, "k", "w") for d, t in docs], SCHEMA).repartition(3)
    for every in (5, 199):
        counts = brute_counts(docs, every)
        found = spelling.word_counts(table, every=every)
        assert {r.word: r.n for r in found.collect()} == {w: n for w, n in counts.items() if len(w) >= 6}
        got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(found, symbols=symbols).collect()), key=str)
        assert got == brute_forms(counts)


def test_neighbourhoods_are_full_and_free_of_repeats(monkeypatch):
    monkeypatch.setattr(spelling, "_ASKED", 16)
    words = ["abcabd", "aaabbb", "zzzzzz", "abcdefg", "é" * 7]
    r = 3
    code = lambda w: tuple(ord(c) % r + 1 for c in w)

    def around(s):
        out = {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}
        out |= {s[:i] + (x,) + s[i + 1 :] for i in range(len(s)) for x in range(1, r + 1)}
        return out | {s[:i] + (x,) + s[i:] for i in range(len(s) + 1) for x in range(1, r + 1)}

    got = defaultdict(list)
    for places, keys in spelling.neighbour_keys(words, r):
        for p, k in zip(places.tolist(), keys.tolist()):
            got[p].append(k)
    letters = "".join(chr(96 + x) for x in range(1, r + 1))
    spell = {ord(c) % r + 1: c for c in letters}
    for i, w in enumerate(words):
        want = {int(spelling.own_keys(["".join(spell[x] for x in s)], r)[0]) for s in around(code(w))}
        assert len(got[i]) == len(set(got[i])) and set(got[i]) == want


def test_roots_follow_chains_of_any_length(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("a", "w20"), ("b", "c")]
    got = {r.word: r.root for r in spelling.roots_of(spark.createDataFrame(links, "word string, form string").repartition(3)).collect()}
    assert got == {**{f"w{i}": "w21" for i in range(21)}, "a": "w21", "b": "c"}
    assert spelling.roots_of(spark.createDataFrame([], "word string, form string")).collect() == []


def test_spelling_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_forms(spelling.word_counts(nothing)).collect() == []


# The registered queries, over the driver's tables


def test_registered_queries_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (d, _), (n, gone, kept) in zip(docs, brute_lines([t for _, t in docs], 10))]
    assert sorted(tuple(r) for r in QUERIES["op12_line_dedup"](spark, sf).collect()) == sorted(want)
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op13_spelling_variants"](spark, sf).collect()), key=str)
    assert got == brute_forms(brute_counts(docs))
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert trie_rows(QUERIES["op11_conversation_trie"](spark, sf)) == brute_trie(turns)
