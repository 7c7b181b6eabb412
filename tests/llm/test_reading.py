import random

import numpy as np
import pytest

from tidelog.llm import markup, reading

BANDS = {b: [f"{stem}{b}" for stem in ("lamp", "stone", "river", "wheel", "field")] for b in (1, 2, 3, 4)}


def text(band, seed, n=120):
    rng = random.Random(seed)
    words = []
    for _ in range(n):
        near = min(4, max(1, band + rng.choice([0, 0, 0, 0, -1, 1])))
        words.append(rng.choice(["the", "of", "and", "is"]) if rng.random() < 0.4 else rng.choice(BANDS[near]))
    return " ".join(words).translate(str.maketrans("1234", "abcd"))


@pytest.fixture(scope="module")
def docs(spark):
    made = [(k, text(k % 4 + 1, k)) for k in range(240)]
    rest = [(900, "der und die das ist " * 20), (901, "the of and " * 5), (902, ""), (903, None), (None, text(1, 0)), (904, "\\section{the of and is to}" * 30), (3, text(4, 3))]
    return spark.createDataFrame(made + rest, "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    grades = [(k, 1, k % 4 + 1) for k in range(160)] + [(k, 2, k % 4 + 1) for k in range(0, 160, 3)]
    grades += [(0, 7, 4), (1, 3, None), (None, 1, 2), (2, 3, 9), (77_777, 1, 1)]
    return spark.createDataFrame(grades, "doc_id long, rater_id int, band int")


def test_held_out_levels(docs, labels):
    found = reading.reading_levels(docs, labels).collect()
    held_out = [r for r in found if 160 <= r.doc_id < 240]
    assert len(held_out) == 80
    assert np.mean([r.band == r.doc_id % 4 + 1 for r in held_out]) > 0.9
    assert sorted({r.doc_id for r in found}) == list(range(240))
    assert sum(r.doc_id == 3 for r in found) == 2


def test_without_labels_or_documents(spark, docs, labels):
    assert reading.reading_levels(docs, labels.limit(0)).count() == 0
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


def test_a_sample_of_the_graded_documents(docs, labels):
    model = reading.fit(docs, labels, sample=80)
    assert 3 <= len(model.grades) <= 24
    held_out = [r for r in reading.reading_levels(docs, labels, model=model).collect() if 160 <= r.doc_id < 240]
    assert np.mean([r.band == r.doc_id % 4 + 1 for r in held_out]) > 0.8


def test_agreed_bands(spark, labels):
    got = {r.doc_id: r.band for r in reading.agreed_bands(labels).collect()}
    assert got[1] == 2
    assert got[0] == 1  # two of three
    assert None not in got
    mixed = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, band int")
    assert reading.agreed_bands(mixed).count() == 0


SPEECH = {
    "en": "the river of the town is wide and this bridge is old but we cross it each day with a small cart and the miller waves to us from his house",
    "de": "der Fluss und die Stadt sind alt und wir gehen jeden Tag mit einem kleinen Wagen durch das Tor weil der Markt am Ende der Gasse liegt",
    "fr": "le moulin et la rive sont dans un champ et nous passons chaque jour avec une petite charrette pour aller au bourg mais sans notre ami",
}


def languages():
    return reading.language_rates([(k, w, text.split().count(w)) for k, text in SPEECH.items() for w in markup.words(text)] * 3)


@pytest.mark.parametrize(("sentence", "expected"), [("this old bridge is wide and we wave to the miller", True), ("die alte Stadt und der Wagen sind klein", False), ("le moulin est dans la rive", False), ("lorem ipsum dolor sit amet is", False), ("", False)])
def test_english(sentence, expected):
    assert languages().english(markup.words(sentence)) is expected


def test_languages_whatever_some_labels_say(spark):
    rng = random.Random(5)
    made, graded = [], []
    for k in range(90):
        own = ("en", "de", "fr")[k % 3]
        words = SPEECH[own].split()
        said = {0: None, 1: "de", 2: "EN ", 3: "und", 4: "x"}.get(k // 3, own)
        made.append((k, " ".join(rng.choice(words) for _ in range(60)), said))
        graded += [(k, 1, k // 3 % 4 + 1)] if own == "en" and k < 30 else []
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(graded, "doc_id long, rater_id int, band int")
    assert sorted(r.doc_id for r in reading.reading_levels(docs, labels).collect()) == list(range(0, 90, 3))


def test_quantiles_of_known_words():
    x = reading.features(["a", "b", "zzz"], {"a": 1.0, "b": 3.0})
    assert x[5] == pytest.approx(2.0)
    assert x[-1] == pytest.approx(2.0)
    assert not reading.features(["zzz"], {}).any()


def test_held_out_grades_of_the_test_tables(spark, data):
    """Half of the graded documents, not fitted on, get the grade raters agree on for most."""
    sf = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "reading_labels"))
    agreed = {r.doc_id: r.band for r in reading.agreed_bands(labels).collect()}
    found = {r.doc_id: r.band for r in reading.reading_levels(docs, labels.filter("doc_id % 2 = 0")).collect()}
    own = [d for d in agreed if d % 2 and d in found]
    assert len(own) >= 20
    assert np.mean([found[d] == agreed[d] for d in own]) > 0.7
