import random

from mediashelf.llm import language
from mediashelf.llm.queries import QUERIES


def longest(text, at, sample):
    end = at
    while end < len(text) and text[at:end + 1] in sample:
        end += 1
    return max(end, at + 1)


def test_phrases_are_greedy_longest_matches():
    rng = random.Random(3)
    samples = {n: ["".join(rng.choices(a, k=120)) for _ in range(2)] for n, a in (("x", "abc "), ("y", "bcd "))}
    model = language.build(samples)
    texts = ["".join(rng.choices("abcde ", k=rng.randint(1, 200))) for _ in range(40)]
    found, n, lettered = language.phrases(texts, model)
    for i, text in enumerate(texts):
        folded = "".join(chr(c) if c else " " for c in language._letters(text).tolist())
        assert n[i] == len(folded) and lettered[i] == bool(folded.strip())
        for j, name in enumerate(model.languages):
            joined = "".join(" " + "".join(chr(c) if c else " " for c in language._letters(t).tolist()) + " "
                             for t in samples[name])
            known = folded if set(folded) <= set(joined) | {"e"} else folded
            count, at = 0, 0
            while at < len(known):
                at = longest(known, at, joined)
                count += 1
            if "e" not in folded and set(folded) <= set(joined):
                assert found[i, j] == count


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language"](spark, sf).where("held_out").join(docs, "doc_id").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.95
    assert rows.score.between(0, 1).all()


def test_nulls_letterless_long_and_unlearned(spark):
    learn = spark.createDataFrame(
        [(1, "the cat and the dog " * 5, "en"), (2, "der hund und die katze " * 5, "de"), (3, "?", None), (4, None, "en")],
        "doc_id bigint, text string, lang string")
    model = language.fit(learn)
    rows = [(1, None, 0), (2, "", 0), (3, "12 !?", 0), (None, "the dog", 0), (5, "die katze und der hund " * 20_000, 0),
            (6, "日本", 0), (6, "日本", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred int")
    found = [(r.id, r.lang_pred, r.score) for r in language.identify(docs, model).collect()]
    names = {i: n for i, n, _ in found}
    assert len(found) == 7 and [names[i] for i in (1, 2, 3)] == ["und"] * 3
    assert names[None] == "en" and names[5] == "de" and names[6] in ("en", "de")
    assert all(0 <= s <= 1 for *_, s in found)
    nothing = language.fit(learn.where("lang IS NULL"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_letters_of_every_plane_and_wide_tables():
    far = chr(0x30010)
    model = language.build({"x": [far * 10 + " abc"], "y": ["abc def"]})
    names, score = language.predictions([far * 10, "def", "\U0010FFFF"], model)
    assert names == ["x", "y", "und"] and score[0] > 0.5
    assert language._letters(far).tolist() == [0x30010]


def test_many_languages(spark):
    """As many languages as there are, each with words of its own; the same with 64-bit places."""
    rng = random.Random(2)
    names = [f"l{i:04d}" for i in range(300)]
    texts = {n: " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(6)) for n in names}
    learn = spark.createDataFrame([(i, texts[n], n) for i, n in enumerate(names)], "doc_id bigint, text string, lang string")
    model = language.fit(learn)
    assert model.languages == tuple(names)
    found = language.identify(learn, model).join(learn.withColumnRenamed("doc_id", "id"), "id").collect()
    assert all(r.lang == r.lang_pred for r in found)
