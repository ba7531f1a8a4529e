"""The letter model: held-out accuracy by language, texts without letters, and its place in the filter recipe."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import filters, languages


@pytest.fixture(scope="module")
def split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0  # copies stay on one side
    return docs.where(~held), docs.where(held)


def test_held_out_accuracy_by_language(split):
    model = languages.fit(split[0])
    rows = languages.with_language(split[1].where(F.char_length("text") >= 40), model).collect()
    right: dict = {}
    for r in rows:
        right.setdefault(r["lang"], []).append(r["language"]["lang"] == r["lang"])
    assert set(right) == {"en", "de", "fr", "es"}
    print({k: (sum(v), len(v)) for k, v in right.items()})
    assert all(sum(v) >= 0.95 * len(v) for v in right.values())
    sure = [r for r in rows if r["language"]["score"] >= 0.65]
    assert len(sure) >= 0.9 * len(rows) and sum(r["language"]["lang"] == r["lang"] for r in sure) >= 0.97 * len(sure)


def test_texts_without_letters_have_no_language(spark, split):
    model = languages.fit(split[0])
    df = spark.createDataFrame([(1, None), (2, ""), (3, " 12 !?"), (4, "a"), (5, "the and of " * 60_000)], "id long, text string")
    got = {r["id"]: r["language"] for r in languages.with_language(df, model).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3)] == [None] * 3 and [got[i]["score"] for i in (1, 2, 3)] == [0.0] * 3
    assert got[4]["lang"] in model.languages and got[5]["lang"] == model.score("the and of")[0]
    with pytest.raises(ValueError, match="learn"):
        languages.fit(df.withColumn("lang", F.lit(None).cast("string")))


def test_long_texts_are_scored_in_pieces(monkeypatch):
    text = "Abc déf, ghi " * 50
    whole = list(languages.trigrams(text))
    monkeypatch.setattr(languages, "AT_ONCE", 7)
    assert [x for part in languages.trigrams(text) for x in part] == whole[0].tolist() and len(whole) == 1


def test_the_recipe_takes_the_language_from_the_text(split):
    model = languages.fit(split[0])
    by_text = {r["doc_id"]: r for r in filters.audit(split[1].drop("lang"), model=model).collect()}
    by_column = {r["doc_id"]: r for r in filters.audit(split[1]).collect()}
    found = {r["doc_id"]: r["language"] for r in languages.with_language(split[1], model).collect()}
    for i, r in by_text.items():
        english = found[i]["lang"] == "en" and found[i]["score"] >= 0.65
        assert r["english"] == english
        if english == by_column[i]["english"]:
            assert r["removed_at"] == by_column[i]["removed_at"]
    assert {r["removed_at"] for r in filters.audit(split[1], model=model, least_score=1.1).collect()} == {"language"}
