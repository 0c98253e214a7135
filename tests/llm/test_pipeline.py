"""The corpus pipeline, stage by stage, on a small table."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from shelfspark.llm import suffix  # noqa: E402


def test_pipeline_runs_and_its_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    make = {"en": ["the", "ing", "tion", "wh", "ed"], "de": ["sch", "ung", "der", "ge", "st"]}
    rows = []
    for i in range(160):
        lang = rng.choice(list(make))
        text = " ".join("".join(rng.choice(make[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 200)))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows.append((500, rows[3][1], rows[3][2], "s0", len(rows[3][1])))  # a copy
    rows.append((501, "1234 5678", "en", "s0", 9))  # no letter
    rows.append((502, None, "en", None, None))
    shared = " ".join(rng.choice(make["en"]) + str(rng.randrange(99)) for _ in range(150))
    rows += [(600 + i, f"{rows[i][1]} {shared}", rows[i][2], "s1", 1) for i in range(20, 23)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert {501, 502} & ids["language_id"] == set() and len(ids["language_id"]) == 164
    assert 500 not in ids["jaccard_join"] and 3 in ids["jaccard_join"]
    texts = {r.doc_id: r.text for r in kept["suffix_dedup"].collect()}
    assert not any(shared in t for t in texts.values())
    assert kept["source_mix"].count() > 0 and kept["retrieval_packing"].count() > 0
    assert ids["retrieval_packing"] == ids["source_mix"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_cuts_passages_of_51_words_and_leaves_50(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 8)))
    make = lambda n: " ".join(word() for _ in range(n))
    over, under, spaced = make(51), make(50), make(51)
    assert len(over) < 400 and len(spaced) < 400
    own = [make(40) for _ in range(7)]
    texts = [f"{own[0]} {over} {own[1]}", f"{over} {own[2]}", f"{own[3]} {under} {own[4]}", under, f"{own[5]} {spaced}", f"{own[6]}\n" + spaced.replace(" ", "\n"), None, " "]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    found = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_strings(spark, docs, "").collect()}
    assert found == {0: f"{own[0]}  {own[1]}", 1: f" {own[2]}", 2: texts[2], 3: under, 4: f"{own[5]} ", 5: f"{own[6]}\n", 7: " "}


@pytest.mark.parametrize("words", [3, 51])
def test_repeated_passages_against_brute_force(spark, words):
    rng = random.Random(words)
    pool = [" ".join(rng.choice(["a", "bb", "c", "dé", "É"]) + str(rng.randrange(40)) for _ in range(words + rng.randrange(-1, 20))) for _ in range(6)]
    texts = ["  ".join(rng.choice(pool) if rng.random() < 0.5 else str(rng.random()) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    split = [t.split() for t in texts]
    places: dict[tuple, list[tuple[int, int]]] = {}
    for i, t in enumerate(split):
        for a in range(len(t) - words + 1):
            places.setdefault(tuple(t[a : a + words]), []).append((i, a))
    gone = [[False] * len(t) for t in split]
    for at in places.values():
        for i, a in at if len(at) > 1 else []:
            gone[i][a : a + words] = [True] * words
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix.remove_repeats(docs, n=10_000, words=words).collect()
    assert {r.doc_id: bytes(r.kept).decode().split() for r in found} == {i: [w for w, x in zip(t, g, strict=True) if not x] for i, (t, g) in enumerate(zip(split, gone, strict=True))}
    assert any(map(any, gone)) and not all(map(all, gone))


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["taken", "size", "copy", "own", "row", "found", "kept", "data", "held", "_row", "n"]
    rows = [(i, f"w{i} " * (20 + i) if i % 5 else None, "en", f"s{i % 2}", *range(len(names))) for i in range(40)]
    form = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in names)
    docs = spark.createDataFrame(rows, form)
    for stage in (corpus_pipeline.mix, corpus_pipeline.remove_repeated_strings, corpus_pipeline.join_near_duplicates):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
        assert all(tuple(r[c] for c in names) == tuple(range(len(names))) for r in out.collect())
        assert stage(spark, docs.limit(0), "").count() == 0


FIELDS = "doc_id long, text string, lang string, source string, n_chars int"


def test_pipeline_of_an_empty_table_is_empty(spark, tmp_path):
    spark.createDataFrame([], FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice(["the", "ing", "wh", "ed"]) for _ in range(3)) for _ in range(60))
    names = ["row", "key", "own", "held", "size", "taken", "copy", "lang_pred", "spans", "component_id"]
    rows = [(i, text(), "en", "s", 1, *[f"{c}{i}" for c in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, f"{FIELDS}, {', '.join(f'`{c}` string' for c in names)}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert all(r.row == f"row{r.doc_id}" and r.component_id == f"component_id{r.doc_id}" for r in out.collect())


def test_texts_unlike_any_learned_language_are_rejected(spark):
    from pyspark.sql import functions as F

    from shelfspark.llm.langid import identify, train_language_model

    rng = random.Random(11)
    make = {"en": ["the", "ing", "tion", "wh", "ed"], "de": ["sch", "ung", "der", "ge", "st"]}
    text = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(50))
    rows = [(i, text(make[lang]), lang) for i, lang in enumerate(["en", "de"] * 60)] + [(900, "12 34 !!", "en"), (901, None, "en"), (902, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(docs, F.lit(True))
    kept = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert {kept[i] for i in (900, 901, 902)} == {"und"}
    assert sum(kept[i] == lang for i, _, lang in rows[:120]) >= 118  # clean documents stay
    assert all(r.lang_pred != "und" for r in identify(docs, model, reject=False).where("doc_id < 900").collect())
