"""Classifiers: accuracy on held-out documents, and rows that are odd."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sealroute.llm import language, quality, toxicity
from sealroute.llm.common import held_out

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "p"), (2, "", "p"), (3, " \n", "p"), (4, "123 --- !", "p"), (None, "the and", "p"), (5, "word " * 400_000, "p"),
       (5, "x" * 600_000, "p")]
SCHEMA = "doc_id bigint, text string, SCORE string"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels")}


def accuracy(rows, truth, guess):
    return np.mean([r[truth] == r[guess] for r in rows])


def test_quality_on_held_out_documents(spark, tables):
    model = quality.train_quality(tables["documents"], tables["labels"])
    scored = quality.score_quality(tables["documents"], model).join(tables["labels"], "doc_id").where(held_out(tables["documents"]["doc_id"]))
    rows = scored.collect()
    assert len(rows) > 50 and accuracy(rows, "quality", "predicted") >= 0.95
    odd = quality.score_quality(spark.createDataFrame(ODD, SCHEMA), model)
    assert odd.columns == ["doc_id", "text", "score", "predicted"]
    got = odd.collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    again = quality.train_quality(tables["documents"], tables["labels"])
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.weights, again.weights)


def test_quality_without_labels_and_long_texts_by_pieces(spark, tables):
    model = quality.train_quality(tables["documents"], tables["labels"].limit(0))
    assert {r.score for r in quality.score_quality(spark.createDataFrame(ODD, SCHEMA), model).collect()} == {0.5}
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_language_on_held_out_documents(spark, tables):
    model = language.train_language(tables["documents"])
    found = language.predict_language(tables["documents"], model).where(held_out(tables["documents"]["doc_id"])).collect()
    assert len(found) > 150 and accuracy(found, "lang", "lang_pred") >= 0.98
    odd = language.predict_language(spark.createDataFrame(ODD, SCHEMA), model)
    assert odd.columns == ["doc_id", "text", "lang_pred", "score"]
    got = odd.collect()
    assert [r.lang_pred for r in got if not (r.text or "").strip() or r.doc_id == 4] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.identified(tables["documents"])
    assert kept.columns == tables["documents"].columns and kept.count() >= 0.99 * tables["documents"].count()


def test_unlike_texts_are_not_identified(spark, tables):
    source = random.Random(4)
    gibberish = " ".join("".join(source.choices("abcdefghijklmnopqrstuvwxyz", k=source.randint(2, 9))) for _ in range(200))
    unlike = [
        gibberish, "".join(source.choices("0123456789abcdef", k=1500)),
        "for (int i = 0; i < n; ++i) { std::vector<double> buf(n * sizeof(x)); if (!buf.empty()) printf(\"%d\", buf[i]->xyz_q); }",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."]
    docs = tables["documents"]
    added = spark.createDataFrame([(-1 - i, text) for i, text in enumerate(unlike)], "doc_id bigint, text string")
    short = spark.createDataFrame([(-99, 'The of token = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab" that 7844238401328224 on the')], "doc_id bigint, text string")
    got = {r.doc_id for r in language.identified(docs.unionByName(added.unionByName(short), allowMissingColumns=True)).select("doc_id").collect()}
    assert not [unlike[-1 - key] for key in got if -99 < key < 0]
    assert -99 in got and len(got) >= 0.99 * docs.count()
    model = language.train_language(docs)
    assert len(model.limits) == 4 and all(0.4 < limit < 0.75 for limit in model.limits)


def test_languages_of_few_ids_and_of_letterless_rows_are_learned(spark):
    rows = [(key, f"the words of {key}", "en") for key in range(400)]
    rows += [(1000 + i % 3, f"zwölf wörter über {i}", "de") for i in range(2000)]
    rows += [(key, None if key % 2 else "123", "fr") for key in range(2000, 2300)] + [(key, "été où ça", "fr") for key in range(2300, 2308)]
    model = language.train_language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows=12)
    assert model.languages == ("de", "en", "fr") and len(model.landmarks) == 12
    again = [(8, "one and the same", "en")] * 500 + [(9, "ein anderer Text", "de")]
    model = language.train_language(spark.createDataFrame(again, "doc_id bigint, text string, lang string"), rows=12)
    assert model.languages == ("de", "en") and len(model.landmarks) == 2


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None), (None, "abc", "en")], "doc_id bigint, text string, lang string")
    model = language.train_language(docs)
    assert model is None
    assert {r.lang_pred for r in language.predict_language(docs, model).collect()} == {"und"}


def test_kernel_is_the_share_of_common_ngrams():
    rows = [("a", language.present("abcd")), ("b", language.present("abxy"))]
    model = language.fit(rows, landmarks=2)
    mask = language.present("abcd")
    value = model.kernel(mask[model.columns][None].astype(np.float32), np.array([mask.sum()]))[0]
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "} for t in (" abcd ", " abxy ")]
    assert value == pytest.approx([1.0, len(grams[0] & grams[1]) / np.sqrt(len(grams[0]) * len(grams[1]))])


def test_toxicity_on_held_out_documents(spark, tables):
    # The smaller table has too few toxic documents to learn every language's words from.
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels)
    known = docs.join(labels, "doc_id").where(held_out(docs["doc_id"])).withColumnRenamed("toxic", "truth")
    rows = toxicity.score_toxicity(known, model).collect()
    assert accuracy(rows, "truth", "toxic") >= 0.97
    assert np.mean([r.toxic for r in rows if r.truth]) >= 0.85
    odd = toxicity.score_toxicity(spark.createDataFrame(ODD, SCHEMA), model)
    assert odd.columns == ["doc_id", "text", "score", "p_severe", "p_marked", "p_toxic", "toxic"]
    assert all(0 <= r.score <= 1 for r in odd.collect())
    none = toxicity.train_toxicity(tables["documents"], tables["labels"].limit(0))
    assert {r.toxic for r in toxicity.score_toxicity(spark.createDataFrame(ODD, SCHEMA), none).collect()} == {False}


def test_chain_reads_earlier_categories_out_of_fold():
    source = random.Random(1)
    words, label = [], []
    for _ in range(600):
        bad = source.random() < 0.3
        found = set(source.sample(range(100, 5000), 30)) | (set(source.sample(range(10), source.randint(1, 8))) if bad else set())
        words.append(np.array(sorted(found)))
        label.append(int(bad))
    model = toxicity.fit_chain(words, words, [np.ones(len(row)) for row in words], np.array(label))
    assert model.categories[-1] == "toxic" and [len(w) - len(model.chosen) - 1 for w in model.weights] == [0, 1, 2]
    strong = np.searchsorted(model.chosen, np.arange(8))

    def found(count):
        return model.probabilities(strong[:count], np.ones(count))

    assert found(8)[-1] > 0.9 > 0.1 > found(0)[-1] and found(8)[0] > found(1)[0]
