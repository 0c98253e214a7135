"""Corpus operators against brute force, on small tables full of hard cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import jaccard, lm, mixing, neardup, packing, sharding, suffix, topk, toxicity
from shelfspark.llm.common import remainder
from shelfspark.llm.components import components
from shelfspark.llm.langid import identify, train_language_model

SCHEMA = "doc_id long, text string, lang string, source string, row string, kept int, size string, part double"
EMPTY = []


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def hard_rows():
    rng = random.Random(4)
    base = words(rng, 220)
    copy = base.split()
    copy[50] = "other"
    passage = words(rng, 120)
    texts = [
        None, "", "  \n\t ", "one", "one two three", base, base, " ".join(copy), base.upper(), words(rng, 300) + " " + passage, passage + "\n" + words(rng, 90),
        words(rng, 9000), "naïve ÉÉ  x " * 30, "ab " * 400, "z" * 3000, "日本語 テキスト " * 60, passage, "1234 5678 !!",
    ]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", None]), "x", 1, "y", 2.0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "text without an id", "en", "s1", "x", None, None, None), (77, base, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame(EMPTY, SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


def groups(links, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (7, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [(a, b) for a, b in links if b is not None and a != b]
    nodes = {n for link in clean for n in link}
    top = groups(clean, nodes)
    least = defaultdict(lambda: 10**9)
    for n in nodes:
        least[top[n]] = min(least[top[n]], n)
    assert found == {n: least[top[n]] for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return data, out


@pytest.mark.parametrize("n,gram", [(400, 100), (40, 10)])
def test_repeated_strings(hard, n, gram):
    rows = hard_rows()
    data, gone = brute_repeats([r[1] for r in rows], n)
    want = sorted((str(r[0]), bytes(np.frombuffer(d, np.uint8)[~g])) for r, d, g in zip(rows, data, gone, strict=True))
    found = suffix.remove_repeats(hard, n=n, gram=gram)
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in found.collect()) == want
    assert set(hard.columns) | {"spans"} == set(found.columns)


def test_repeated_strings_in_random_texts(spark):
    rng = random.Random(9)
    parts = [words(rng, 12, 30) for _ in range(12)]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.5 else words(rng, 6, 5) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    data, gone = brute_repeats(texts, 50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r.doc_id: r for r in suffix.remove_repeats(docs, n=50, gram=12).collect()}
    for i, (d, g) in enumerate(zip(data, gone, strict=True)):
        assert bytes(found[i].kept) == bytes(np.frombuffer(d, np.uint8)[~g])
        assert sum(s.hi - s.lo for s in found[i].spans) == g.sum()


def test_repeats_of_nothing(nothing):
    assert suffix.remove_repeats(nothing).count() == 0


def brute_jaccard(rows, k, num, den):
    sets = []
    for r in rows:
        w = tokens(r[1])
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    top = groups(links, range(len(sets)))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[top[i]].append(r[0])
    least = {t: min((x for x in v if x is not None), default=None) for t, v in ids.items()}
    return sorted((str(r[0]), len(s), str(least[top[i]])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard_join(hard, nothing):
    found = jaccard.jaccard_components(hard, words=4, num=85, den=100)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute_jaccard(hard_rows(), 4, 85, 100)
    assert jaccard.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("num,den,block", [(85, 100, 128), (80, 100, 3), (50, 100, 2)])
def test_jaccard_join_loses_no_link(spark, num, den, block):
    rng = random.Random(num)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([6, 9, 15, 40, 80, 200]), 3000).split()
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard.jaccard_components(docs, words=4, num=num, den=den, block=block)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute_jaccard(rows, 4, num, den)


def test_keep_one(hard):
    kept = jaccard.keep_one(hard, jaccard.jaccard_components(hard))
    assert kept.columns == hard.columns
    texts = [r.text for r in kept.collect()]
    base = hard_rows()[5][1]
    assert texts.count(base) == 1 and base.upper() not in texts and "" in texts and None in texts


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(3)
    rule = jaccard.Rule(85, 100)
    level = rng.integers(0, 4, 1 << jaccard.CELLS, dtype=np.uint8)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(300) > 0.05], rng.integers(0, 1 << 63, 8, dtype=np.uint64)))) for _ in range(40)]
    a, b = jaccard.bounded_pairs([jaccard.count_vector(s) for s in sets], np.array([len(s) for s in sets]), np.arange(40), rule)
    met = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(40):
        for j in range(i):
            if rule.links(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))):
                assert (j, i) in met
                pages = [set(jaccard.page_keys(sets[x], rule, level).tolist()) for x in (i, j)]
                assert pages[0] & pages[1]


def test_lm_scores(hard, nothing):
    rows = hard_rows()
    learn = lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2
    c = Counter()
    for r in rows:
        if learn(r):
            c.update([*tokens(r[1]), None])
    n, v = sum(c.values()), len(c)
    found = lm.score_texts(hard, remainder("doc_id", 7) != 2, head=40, common=50).collect()
    assert len(found) == len(rows)
    by = {(str(r[0])): r for r in rows}
    for f in found:
        t = [*tokens(by[str(f.doc_id)][1]), None]
        assert (f.n_tokens, f.n_known, f.train_tokens, f.learned) == (len(t), sum(c[x] > 0 for x in t), n, learn(by[str(f.doc_id)]))
        assert f.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert f.score < 0
    assert lm.score_texts(nothing, F.lit(True)).count() == 0


def test_lm_learns_what_follows(spark):
    rng = random.Random(12)
    after = {f"w{i}": [f"w{(3 * i + j) % 30}" for j in (1, 7)] for i in range(30)}

    def text():
        w = [f"w{rng.randrange(30)}"]
        while len(w) < 60:
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.9 else f"w{rng.randrange(30)}")
        return " ".join(w)

    docs = spark.createDataFrame([(i, text()) for i in range(3000)], "doc_id long, text string").repartition(2)
    held = remainder("doc_id", 7) == 2
    gain = lambda **k: lm.score_texts(docs, ~held, head=64, **k).where("not learned").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
    once, twice = gain(rates=(0.05,)), gain()
    assert twice > once > 0.1


def test_lm_probabilities_add_up():
    rng = np.random.default_rng(2)
    head = np.append(rng.integers(1, 1 << 62, 9, dtype=np.uint64), lm.END)
    model = lm.new_model(head, np.arange(10, 0, -1), 5, 4, 1)
    ids = rng.integers(0, 11, (4000, 3))
    ids[:, 2] = (ids[:, 1] + 1) % 11
    state = []
    for _ in range(5):  # 4000 rows are one batch of the default size, a single step
        lm.nce_steps(model, ids, np.full(11, 1 / 11), rng, state, batch=64)
    near, far, norm = model.tables()
    p = np.exp(near[:, None] + far[None] - norm[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    assert p[ids[:, 1], ids[:, 0], ids[:, 2]].mean() > 0.2  # an even guess has 1/11


def test_packing(spark, hard, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = hard_rows()
    want = Counter((str(r[0]), tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    found = packing.pack(hard, path, window=256, shard_bytes=4000).toPandas()
    sequences = found.sort_values("offset").groupby("sequence_id")
    for _, s in sequences:
        assert (s.offset.to_numpy() == np.concatenate(([0], np.cumsum(s.length)[:-1]))).all() and s.length.sum() <= 256
    total = sequences.length.sum()
    assert all(x == 256 or x & (x - 1) == 0 for x in total)
    assert found.length.sum() == sum(len(k[1]) * n for k, n in want.items())
    for (doc, ids), n in want.items():
        mine = found[(found.doc_id.map(lambda x: "None" if pd.isna(x) else str(int(x))) == doc) & (found.doc_tokens == len(ids))]
        pieces = Counter((p.start, p.length, p.ids_crc32) for p in mine.itertuples())
        assert mine.length.sum() == len(ids) * n
        for start, size, crc in pieces:
            assert zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()) == crc
    assert packing.pack(nothing, path).count() == 0


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(5)
    topics = [rng.integers(100 * k, 100 * k + 60, (20, 30)) for k in range(4)]
    flat = np.concatenate([topics[i % 4][i // 4] for i in range(80)])
    index = packing.BM25Shard(flat, np.arange(81) * 30)
    windows = packing.fill_windows(np.full(80, 30), index, 150)
    pure = [len({d % 4 for d, _, _ in w}) == 1 for w in windows]
    assert sum(pure) >= len(pure) * 0.7
    assert Counter(d for w in windows for d, _, n in w for _ in range(n)) == Counter({d: 30 for d in range(80)})


def test_mixing(hard, nothing):
    rows = hard_rows()
    found = mixing.mix_sources(hard, shard_rows=3).toPandas()
    assert sorted(found["size"]) == sorted(len(tokens(r[1])) for r in rows)
    assert (found.taken <= 3 * found["size"]).all()
    by = found.groupby(found.source.fillna("null")).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), whole=("source_size", "first"))
    assert (by["size"] == by.whole).all() and by.target.sum() == pytest.approx(by["size"].sum())
    assert ((by.taken - by.target).abs() <= 3).all()
    again = mixing.mix_sources(hard.repartition(5), shard_rows=3).toPandas()
    assert sorted(found.fillna(-1)[["doc_id", "size", "taken"]].itertuples(index=False)) == sorted(again.fillna(-1)[["doc_id", "size", "taken"]].itertuples(index=False))
    assert mixing.mix_sources(nothing).count() == 0


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(8)
    weights = [rng.choice([0.0, 1.0, 2.5, 40.0, rng.random() * 90]) for _ in range(17)]
    rows = spark.createDataFrame([("g", i, w, 101) for i, w in enumerate(weights)], "g string, k int, w double, s long")
    found = {r.k: r.won for r in mixing.apportion(rows, ["g"], "k", "w", "s").collect()}
    seats = [0] * 17
    for _ in range(101):
        best = max(range(17), key=lambda i: (weights[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    assert [found[i] for i in range(17)] == seats


def test_sharding(hard, nothing):
    found = sharding.pack_shards(hard, shards=4).toPandas()
    assert sorted(found["size"]) == sorted(len((r[1] or "").encode()) + 8 for r in hard_rows())
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    crc = {zlib.crc32((r[1] or "").encode()) for r in hard_rows()}
    assert set(found.text_crc32) == crc and (found.groupby("text_crc32").shard.nunique() == 1).all()
    assert sharding.pack_shards(nothing).count() == 0


def test_sharding_balances_and_cuts_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(5, 60))) for i in range(600)] + [(1000 + i, "the same text, again and again") for i in range(2000)]
    found = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, cell_groups=100).toPandas()
    total = found.groupby("shard")["size"].sum()
    assert total.max() / total.mean() < 1.05 and total.min() / total.mean() > 0.95


def vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0.02, 0.06, 1.0])
        rows.append((i, [float(x) for x in v], int(i % 3)))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [float("inf")] + [1.0] * 15, 1), (404, [None] + [1.0] * 15, 1), (405, rows[5][1], None), (406, rows[7][1], rows[7][2]), (407, rows[7][1], rows[7][2]), (408, [1.0, 2.0], 1), (409, [2.0, 4.0], 1), (410, [], 1)]
    rows += [rows[9]]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(4)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_near_duplicates(spark):
    rows, df = vectors(spark)
    links, n = [], [0] * len(rows)
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows[:i]):
            if x is not None and x == y and usable(a) and usable(b) and len(a) == len(b) and any(a) and any(b):
                a_, b_ = np.array(a), np.array(b)
                if a_ @ b_ / np.linalg.norm(a_) / np.linalg.norm(b_) >= 0.98:
                    links.append((i, j))
                    n[i] += 1
                    n[j] += 1
    top = groups(links, range(len(rows)))
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        least[top[i]] = min(least[top[i]], r[0])
    want = sorted((r[0], n[i], least[top[i]], least[top[i]] == r[0]) for i, r in enumerate(rows))
    for cell_rows in (4000, 4):
        found = neardup.near_duplicates(df, tables=12, probes=2, cell_rows=cell_rows, bucket_entries=200)
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert sum(g[1] for g in got) >= 0.9 * sum(n) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        if cell_rows == 4000:
            first = got
    assert got == first
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [16, 64])
def test_near_duplicates_by_default_find_close_calls(spark, size):
    rng = np.random.default_rng(size)
    rows, pairs = [], 1000
    for i in range(pairs):
        a, b = rng.standard_normal((2, size))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cos = rng.uniform(0.9801, 0.985)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (cos * a + math.sqrt(1 - cos * cos) * b / np.linalg.norm(b)).tolist(), 1)]
    unit = np.array([r[1] for r in rows])
    linked = np.triu(unit @ unit.T >= 0.98, 1).sum()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    recall = neardup.near_duplicates(df).agg(F.sum("n_links")).first()[0] / 2 / linked
    print(f"recall at cosine 0.98 to 0.985, {size} components, {linked} pairs: {recall:.3f}")
    assert linked >= pairs and recall >= 0.9


def test_e8_points():
    x = np.random.default_rng(1).standard_normal((2000, 8)) * 3
    p = neardup.e8(x)
    assert ((p % 2 == 0).all(1) | (p % 2 == 1).all(1)).all() and (p.sum(1) % 4 == 0).all()
    assert np.linalg.norm(x - p / 2, axis=1).max() <= 1 + 1e-9  # the covering radius


@pytest.mark.parametrize("block_rows", [16_384, 50])
def test_exact_top_k(spark, block_rows):
    rows, df = vectors(spark)
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if usable(v)}
    many = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if usable(v)]
    want = []
    for i in sorted(q):
        if i % 50 == 0:
            best = sorted((-int(v @ q[i]), j) for j, v in many if j != i and len(v) == len(q[i]))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=block_rows, query_rows=3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_top_k_of_wide_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randrange(0, 7) for _ in range(4)]) for i in range(60)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for own in (0, 20, 40):
        want = sorted((-sum(a * b for a, b in zip(q[own], q[i], strict=True)), i) for i in q if i != own)[:5]
        assert [(r.score, r.vec_id) for r in sorted((x for x in found if x.query_id == own), key=lambda x: x.rank)] == [(-s, i) for s, i in want]


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_wide_rows_stand_beside_the_index(share):
    rng = np.random.default_rng(5)
    values = rng.integers(-300, 300, (500, 6)).astype(float)
    wide = rng.random(500) < share
    values[wide] = values[wide] * 2.0 ** rng.integers(17, 21, (wide.sum(), 1)) + rng.integers(-99, 99, (wide.sum(), 6))  # sums beyond 53 bits
    values[1] = values[0]  # a tie
    ids = np.arange(500) * 3
    ids[7] = ids[8]  # a repeated key
    asked = np.concatenate([np.flatnonzero(wide)[:4], np.arange(6)])
    for own, best, scores in topk.search(values, ids, values[asked], ids[asked], 5):
        query = [int(x) for x in values[np.flatnonzero(ids == own)[0]]]
        want = sorted((-sum(int(a) * b for a, b in zip(v, query, strict=True)), i) for v, i in zip(values, ids.tolist(), strict=True) if i != own)[:5]
        if own != ids[7]:
            assert [(-s, i) for s, i in zip(scores, best, strict=True)] == want


def test_wide_scores_that_fit_in_no_long():
    values = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-1.0, 0.0]])
    with pytest.raises(ValueError, match="long"):
        list(topk.search(values, np.arange(3), values[:1], np.arange(1), 1))
    assert list(topk.search(values[1:], np.arange(1, 3), np.array([[0.0, 3.0]]), np.array([9]), 5)) == [(9, [1, 2], [6, 0])]
    with np.errstate(all="ignore"):
        assert list(topk.search(np.array([[1e308, 1e308], [4.0, 4.0]]), np.arange(2), np.array([[1.0, -1.0]]), np.array([9]), 1)) == [(9, [0], [0])]


def test_exact_top_k_of_a_block_with_one_wide_row(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows[5] = (5, [1e6] * 8)
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for own in range(0, 400, 50):
        want = sorted((-sum(a * b for a, b in zip(q[own], q[i], strict=True)), i) for i in q if i != own)[:5]
        assert [(r.score, r.vec_id) for r in sorted((x for x in found if x.query_id == own), key=lambda x: x.rank)] == [(-s, i) for s, i in want]


def test_bitmap_sums():
    rng = np.random.default_rng(3)
    values = rng.integers(-256, 256, (300, 9))
    index = topk.BitSlicedIndex(values, 0)
    w = rng.integers(-20, 20, 9)
    slices = index.sums(w)
    got = sum((topk.unpack(s, 300).astype(np.int64) << i) for i, s in enumerate(slices))
    span = values - index.low
    top = (1 << index.bits) - 1
    assert (got == np.where(w >= 0, span * w, (top - span) * -w).sum(1)).all()


def test_language_id(spark, hard, nothing):
    rng = random.Random(5)
    make = {"aa": "ka lo mi ", "bb": "st rt ung ", "cc": "oui eau ch "}
    rows = [(i, "".join(rng.choice(make[g].split()) + rng.choice(["", " "]) for _ in range(60)), g) for i in range(600) for g in [rng.choice(list(make))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(docs, F.col("doc_id") % 5 != 0, per_language=150)
    found = identify(docs, model).where("doc_id % 5 = 0")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    hard_found = identify(hard, model, reject=False).collect()
    for r in hard_found:
        assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or "")) and 0 <= r.lang_score <= 1
    assert identify(nothing, train_language_model(nothing, F.lit(True))).count() == 0
    assert {r.lang_pred for r in identify(hard, train_language_model(nothing, F.lit(True))).collect()} == {"und"}


def test_toxicity(spark, hard, nothing):
    rng = random.Random(6)
    bad = [f"bad{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(900):
        w = words(rng, rng.randrange(20, 120), 2000).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    index = toxicity.fit_index(docs, marks, ~toxicity.held_out())
    found = toxicity.score_toxicity(docs, index).join(marks, "doc_id").where(toxicity.held_out()).collect()
    right = sum((r.tox_score >= 0.3) == bool(r.toxic) for r in found)
    assert right >= 0.97 * len(found) and all(0 <= r.tox_score <= 1 for r in found)
    some = max(found, key=lambda r: r.tox_score)
    assert some.tox_evidence[0].toxic == 1
    assert toxicity.score_toxicity(hard, index).count() == len(hard_rows())
    blank = toxicity.fit_index(nothing, marks.limit(0), F.lit(True))
    assert {r.tox_score for r in toxicity.score_toxicity(hard, blank).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, index).count() == 0


def test_toxicity_hears_every_word_of_the_examples(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(60):  # words of a few toxic examples each: too few to stand out by themselves
        own = [f"f{i}x{j}" for j in range(25)]
        for copy in range(6):
            rows.append((f"t{6 * i + copy}", " ".join(own[:copy] + own[copy + 1 :])))
            labels.append((f"t{6 * i + copy}", 1))
    for i in range(1000, 1800):
        rows.append((f"c{i}", words(rng, 60, 2000)))
        labels.append((f"c{i}", 0))
    docs, marks = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, toxic int")
    held = F.substring("doc_id", 2, 9).cast("int") % 6 == 0
    docs = docs.withColumn("found", F.lit(1)).withColumn("tox_score", F.lit(2.0))
    found = toxicity.score_toxicity(docs, toxicity.fit_index(docs, marks, ~held)).join(marks, "doc_id").where(held).collect()
    assert found and all((r.tox_score >= 0.3) == bool(r.toxic) for r in found)
    assert all(r.tox_evidence[0].toxic == r.toxic and r.found == 1 for r in found)


def test_toxicity_against_brute_force(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", *[f"w{j}" for j in range(40)]] + ["bad"] * (6 * (i % 3 == 0))) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "zz")], "doc_id long, text string")
    index = toxicity.fit_index(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"), F.lit(True), k=5)
    assert len(index.ids) == 225 and index.knots is not None
    texts = dict(rows)
    df = Counter(w for _, t in [*rows, (0, ""), (901, "zz")] for w in set(t.split()))
    names = sorted({w for i in index.ids for w in texts[i].split()}, key=lambda w: toxicity.word_counts([w.encode()])[0][0][0])
    mine, y = [Counter(texts[i].split()) for i in index.ids], index.toxic
    share, factor = y.mean(), {}
    for w in names:
        n, bad = sum(w in c for c in mine), sum(t for c, t in zip(mine, y, strict=True) if w in c)
        s = bad / n
        apart = n * (s * math.log(s / share) + ((1 - s) * math.log((1 - s) / (1 - share)) if s < 1 else 0)) if s > share else 0
        factor[w] = (math.log(303 / (df[w] + 1)) + 1) * (0.02 + math.sqrt(max(apart - 4, 0)))

    def unit(c):
        v = {w: (1 + math.log(n)) * factor[w] for w, n in c.items() if w in factor}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = [unit(c) for c in mine]
    for r in toxicity.score_toxicity(docs, index, k=5).collect():
        v = unit(Counter((r.text or "").split()))
        cos = sorted(((-sum(x * e.get(w, 0) for w, x in v.items()), i) for i, e in enumerate(vectors)))[:5]
        if not v:
            assert r.tox_score == pytest.approx(share) and not r.tox_evidence
            continue
        vote = [(1 / (1.02 + c), y[i]) for c, i in cos if c < 0]
        raw = (sum(w * t for w, t in vote) + share) / (sum(w for w, _ in vote) + 1)
        assert [e.cosine for e in r.tox_evidence] == pytest.approx([-c for c, _ in cos[:3]])
        assert r.tox_score == pytest.approx(float(np.interp(raw, *index.knots)), abs=1e-6)


@pytest.mark.parametrize("block", [4, 16, 64])
def test_nearest_examples_are_exact_and_blocks_are_skipped(block):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        t = np.unique(np.append(np.minimum(rng.zipf(1.3, 12), 300), 301 + i // 8)).astype(np.int64)
        rows.append((t, rng.integers(1, 5, len(t))))
    factor = rng.random(360) + 0.5
    factor[301:] += 6
    index = toxicity.BlockMaxIndex(np.arange(360).astype(np.uint64), factor, list(range(400)), np.zeros(400), 0.0, block=block)
    index.build(rows)
    assert 0 < len(index.often) < 100
    dense = np.zeros((400, 360))
    for i, (t, n) in enumerate(rows):
        dense[i, t] = index.weigh(t, n)
    asked = np.arange(0, 400, 16)
    for i, (found, cos) in zip(asked, index.nearest([rows[i] for i in asked], 7, asked), strict=True):
        all_cos = dense @ dense[i]
        all_cos[i] = 0
        best = np.sort(all_cos)[::-1][:7]
        assert np.allclose(cos, best[best > 0]) and np.allclose(all_cos[found], cos) and i not in found
    assert block > 16 or index.opened < len(asked) * (400 // block) // 2


def test_kept_digest_round_trip():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
