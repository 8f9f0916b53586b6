"""A language model learned from all documents, whole or split into arrays and a table."""

import random

import pytest

import corpus_pipeline
from triflux.llm import langid

DOCS = "doc_id long, text string, lang string"


def _rows(n=120):
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopqrst"}
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        words = ["".join(rng.choices(letters[lang], k=rng.randint(1, 7))) for _ in range(30)]
        rows.append((i, " ".join(words), lang))
    return rows


def test_every_labelled_document_teaches(frame, monkeypatch):
    # A sample of one a language would leave nearly all words unknown.
    monkeypatch.setattr(langid, "SAMPLE", 1)
    monkeypatch.setattr(langid, "DOCUMENTS", 1)
    monkeypatch.setattr(langid, "FITTED", 1)
    seen = []
    real = langid._fit
    monkeypatch.setattr(langid, "_fit", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = frame(_rows(), DOCS)
    corpus_pipeline.identify_language(docs.sparkSession, docs, "").count()
    taught = docs.where(~langid.held_out()).collect()
    words = {w for r in taught for w in r.text.split()}
    assert len(seen[0].tables[langid.WORD].keys) == len(words)


@pytest.mark.parametrize("held", [0, 300])
def test_a_split_model_judges_as_a_whole_one(frame, monkeypatch, held):
    odd = [
        (900, None, "aa"), (901, "", None), (902, "12 34 _", None), (903, "и в не на", None),
        (904, "abcde zzz abcd " * 9, None), (905, "q", None), (None, "abcdefgh mnop", "cc"), (906, "é ab", None),
    ]
    rows = _rows() + odd
    docs = frame(rows + rows[:7] + odd, DOCS)
    whole = langid.learn_all(docs)
    assert whole.rest is None
    monkeypatch.setattr(langid, "HELD", held)
    split = langid.learn_all(docs)
    assert split.rest is not None
    assert split.usual == pytest.approx(whole.usual, abs=1e-6)

    def key(r):
        return str(r)

    one, two = (sorted(map(tuple, langid.predict(docs, m).collect()), key=key) for m in (whole, split))
    assert [x[:3] for x in one] == [x[:3] for x in two]
    assert [x[3] for x in two] == pytest.approx([x[3] for x in one], abs=1e-5)
    kept = [sorted(map(tuple, langid.accepted(docs, m).collect()), key=key) for m in (whole, split)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()


def test_texts_that_fit_by_held_words_go_through_no_join(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 300)
    model = langid.learn_all(spark.createDataFrame(_rows(), DOCS))
    assert model.rest is not None
    plain = [(i, "a b c d", None) for i in range(20)]
    seen = []
    real = langid._judged
    monkeypatch.setattr(langid, "_judged", lambda docs, m: seen.extend(docs.collect()) or real(docs, m))
    kept = langid.accepted(spark.createDataFrame([*plain, (30, None, None), (31, "12", None)], DOCS), model)
    assert sorted(map(tuple, kept.collect())) == plain and not seen
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    mixed = [*plain, (40, "a zzzzz", None), (41, "zzzzz", None)]
    kept = langid.accepted(spark.createDataFrame(mixed, DOCS), model)
    assert [r.text for r in seen] == ["zzzzz"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 40]


def test_unseen_words_where_only_letters_were_learned(spark):
    letters = spark.createDataFrame([(i, "a b c d", "aa") for i in range(8)], DOCS)
    model = langid.learn_all(letters)
    assert model.rest is None
    other = spark.createDataFrame([(1, "xyxy", None), (2, "a b xyxy", None)], DOCS)
    assert [r.doc_id for r in langid.accepted(other, model).collect()] == [2]


def test_nothing_to_learn(frame):
    empty = frame([], DOCS)
    assert langid.accepted(empty, langid.learn_all(empty)).count() == 0
