"""The pipeline's stages against brute force on a small table, written and read again between stages as the driver does."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from halyard.llm import language, packing, pii
from test_llm_operators import WORDS, brute_groups, brute_spans, check_packing, near_copies


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = near_copies(rng)
    texts += [f"call +1 (555) 010-{k:04d} or mail someone{k}@mail{k}.example.com about {' '.join(rng.choice(WORDS) for _ in range(30))}" for k in range(10)]
    texts += ["12345 !!! ??", None, "", "漢字漢字", "card 4111 1111 1111 1111 and host 10.0.0.1 " + " ".join(rng.choice(WORDS) for _ in range(40))]
    rows = [(k, t, "en" if k % 9 else None, f"src{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, texts


def test_stages(spark, table, tmp_path):
    path, texts = table
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), dict(enumerate(texts))
    names = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        names.append(name)
        if name != "packing":
            assert sorted(out.dtypes) == sorted(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        got = {r.doc_id: r for r in rows}
        if name == "language_id":
            # all labelled text is one language in Latin letters: what has none goes
            left = {k: t for k, t in left.items() if re.search(r"[^\W\d_]", t or "") and "漢" not in t}
            assert {k: r.text for k, r in got.items()} == left and {r.lang for r in rows} == {"en"}
        if name == "near_duplicates":
            keys = sorted(left)
            _, root, _ = brute_groups([left[k] for k in keys], 5, 80)
            left = {keys[k]: left[keys[k]] for k in set(root)}
            assert {k: r.text for k, r in got.items()} == left and len(rows) == len(left)
        if name == "pii":
            holds = defaultdict(set)
            assert got.keys() == left.keys()
            for k, t in left.items():
                want = pii.apply_spans(t, [(a, kind, b) for a, kind, b in brute_spans(t)])
                assert got[k].text == want and got[k].n_chars == len(want)
                holds["changed"] |= {k} if want != t else set()
                assert not brute_spans(got[k].text)
            assert len(holds["changed"]) == 11
            left = {k: r.text for k, r in got.items()}
        if name == "packing":
            sizes = check_packing_rows(rows, left)
            assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    assert names == ["language_id", "near_duplicates", "pii", "packing"]


def check_packing_rows(rows, left):
    enc = packing.encoder(*next(iter(packing._encoders), (None, None))) if packing._encoders else None
    texts, by_id = [], {}
    for place, k in enumerate(sorted(left)):
        place += place >= 3  # check_packing keeps 3 for the row without an id
        by_id[k] = place
        while len(texts) < place:
            texts.append(None)
        texts.append(left[k])
    moved = [type("Row", (), {**r.asDict(), "doc_id": by_id[r.doc_id]}) for r in rows]
    end = type("Row", (), {"doc_id": None, "start": 0, "length": 1, "ids": [packing.END_ID], "doc_tokens": 1, "ids_crc32": __import__("zlib").crc32(b"\1\0\0\0"), "sequence_id": -1, "offset": 0})
    del enc
    return check_packing([*moved, end], texts, packing.Limits())[:-1]


def test_run_is_the_stages(spark, table):
    path, _ = table
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, table, tmp_path):
    path, _ = table
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_keeps_mixed_text(spark):
    rng = random.Random(3)
    letters = {"one": "abcdef", "two": "ghijkl", "three": "mnopqr", "four": "опрстуф"}
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    model = language.fit(spark.createDataFrame([(k, say(lang, 40), lang) for k, lang in enumerate(list(letters) * 20)], "doc_id long, text string, lang string"))
    texts = {1: " ".join(say(lang, 20) for lang in letters), 2: say("one", 20) + " " + "漢字漢字漢 " * 40, 3: say("two", 8) + " " + say("three", 8) + " " + "漢字漢字漢 " * 24}
    df = spark.createDataFrame([(k, t, None) for k, t in texts.items()], "doc_id long, text string, lang string")
    kept = {r.doc_id: r for r in language.keep_identified(df, model).collect()}
    assert kept.keys() == {1, 2, 3} and all(r.text == texts[k] for k, r in kept.items()) and kept[2].lang == "one"


def test_language_stage_keeps_columns_that_are_not_its_own(spark):
    df = spark.createDataFrame([(1, "abc def", "x", 5)], "doc_id long, text string, lang string, score int")
    kept = language.keep_identified(df, language.fit(df))
    assert [r.asDict() for r in kept.collect()] == [{"doc_id": 1, "text": "abc def", "lang": "x", "score": 5}]
