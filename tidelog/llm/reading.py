"""The reading level of a document from the grades at which its words are acquired."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import markup
from tidelog.plans.common import materialize, spread

BANDS = 4
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
#: Graded documents that the grades and the calibration are fitted on, at most (a random part, by hash, of more).
SAMPLE_DOCUMENTS = 20_000

#: Documents of each language that its words are learnt from, at most (likewise).
LANGUAGE_DOCUMENTS = 500
#: Least share of a text's words that must be known in a language for the text to be in it.
KNOWN_SHARE = 0.25


@dataclass(frozen=True)
class Languages:
    """How often words occur in each language, as logarithms of rates; the first language is English."""

    names: tuple[str, ...]
    place: dict[str, int]
    rates: np.ndarray  # words x languages
    known: np.ndarray  # words x languages: whether the word is one of the language's own

    def english(self, words: list[str]) -> bool:
        """Whether a text is likelier in English than in any other language known, and enough of its words are known in it."""
        return self.english_at(np.array([k for k in map(self.place.get, words) if k is not None], np.int64), len(words))

    def english_at(self, places: np.ndarray, n_words: int) -> bool:
        """english() of a text by the places of its known words."""
        if not len(places) or np.count_nonzero(self.known[places, 0]) < KNOWN_SHARE * n_words:
            return False
        return int(self.rates[places].sum(axis=0).argmax()) == 0


@dataclass(frozen=True)
class Model:
    grades: dict[str, float]  # the mean grade of a word, of the words known
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # calibration of the quantiles: one column for each band
    languages: Languages


def features(words: list[str], grades: dict[str, float]) -> np.ndarray:
    """Quantiles and mean of the grades of the known words; zeros without any."""
    return summary(np.array([g for g in map(grades.get, words) if g is not None]))


def summary(known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(QUANTILES) + 1)
    known = np.sort(known)
    at = QUANTILES * (len(known) - 1)
    low = at.astype(int)
    high = np.minimum(low + 1, len(known) - 1)
    return np.append(known[low] + (at - low) * (known[high] - known[low]), known.mean())


def acquisition_grades(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """The grade of each word from its counts by band (words x bands): the mean band of its rates, smoothed towards all words'."""
    totals = np.maximum(counts.sum(axis=0), 1)
    rates = (counts + smoothing * totals / totals.sum()) / totals
    return (rates / rates.sum(axis=1, keepdims=True)) @ np.arange(1, BANDS + 1)


def calibrate(x: np.ndarray, band: np.ndarray, steps: int = 2_000, rate: float = 0.3, shrink: float = 1e-3):
    """Softmax regression of the bands on standardised features, by gradient descent from zero."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    target = np.eye(BANDS)[band - 1]
    weights = np.zeros((z.shape[1], BANDS))
    for _ in range(steps):
        p = np.exp(z @ weights)
        p /= p.sum(axis=1, keepdims=True)
        weights -= rate * (z.T @ (p - target) / len(z) + shrink * weights)
    return centre, scale, weights


def predict(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), (x - model.centre) / model.scale])
    return (z @ model.weights).argmax(axis=1) + 1


def _prose(batches, least: int):
    """The words of the prose of each text with at least ``least`` of them. Further columns stay."""
    for batch in batches:
        rows = [(k, markup.words(markup.prose(text))) for k, text in enumerate(batch.column("text").to_pylist())]
        kept = [(k, w) for k, w in rows if len(w) >= least]
        rest = batch.drop_columns(["text"]).take(pa.array([k for k, _ in kept], pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([w for _, w in kept], pa.list_(pa.string()))], [*rest.schema.names, "words"])


def _graded(batches, model: Model, least: int):
    # every word is looked up once: its place among the words of the languages, and by that its grade
    place = model.languages.place
    grade = np.full(len(place), np.nan)
    rest = {}
    for word, g in model.grades.items():
        if word in place:
            grade[place[word]] = g
        else:
            rest[word] = g
    for batch in batches:
        ids, rows = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = markup.words(markup.prose(text))
            if len(words) < least:
                continue
            at = np.array([k for k in map(place.get, words) if k is not None], np.int64)
            if model.languages.english_at(at, len(words)):
                known = grade[at]
                known = known[~np.isnan(known)]
                if rest:
                    known = np.append(known, [rest[w] for w in words if w in rest])
                ids.append(doc)
                rows.append(summary(known))
        band = predict(np.array(rows), model) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(band.astype(np.int64))], ["doc_id", "band"])


def agreed_bands(labels: DataFrame) -> DataFrame:
    """doc_id, band: the median of a document's grades where it is a whole band; null grades and grades outside the scale don't count."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("band").between(1, BANDS))
    middle = rows.groupBy("doc_id").agg(F.median("band").alias("band"))
    return middle.filter(F.col("band") == F.floor("band")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("band").cast("int").alias("band"))


def language_rates(counts: list[tuple[str, str, int]], least_count: int = 3, smoothing: float = 0.5) -> Languages:
    """Languages from (language, word, n). English comes first; a word is a language's own if it isn't ten times as frequent in another one."""
    names = ("en", *sorted({language for language, _, _ in counts} - {"en"}))
    total: dict[str, int] = {}
    for _, word, n in counts:
        total[word] = total.get(word, 0) + n
    place = {w: k for k, w in enumerate(sorted(w for w, n in total.items() if n >= least_count))}
    table = np.full((len(place), len(names)), smoothing)
    for language, word, n in counts:
        if word in place:
            table[place[word], names.index(language)] += n
    rates = table / table.sum(axis=0)
    return Languages(names, place, np.log(rates), (table >= 1) & (10 * rates >= rates.max(axis=1, keepdims=True)) if len(place) else table > 0)


def fit_languages(documents: DataFrame, graded: DataFrame, least: int, sample: int = LANGUAGE_DOCUMENTS) -> Languages:
    """The words of each language from documents that say theirs in ``lang``; what is graded is English too. At most about ``sample`` of each are used.

    Labels may be wrong or missing at times: a word counts for a language with its rate, so a few documents under the wrong label hardly move it. Labels
    are read by their first two letters, whatever the case; "und" and others without two documents that agree say nothing.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang")] if "lang" in documents.columns else [F.lit(None).cast("string").alias("lang")]))
    said = texts.dropna().filter(F.col("lang").rlike("^[a-z]{2}$") & (F.col("lang") != "un"))
    n = {r.lang: r.n for r in said.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect() if r.n > 1}  # one row for each two letters
    share = F.lit(0.0)
    for language, k in n.items():
        share = F.when(F.col("lang") == language, min(1.0, sample / k)).otherwise(share)
    chosen = said.filter(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "lang", "text")
    words = spread(chosen).mapInArrow(lambda b: _prose(b, least), "doc_id bigint, lang string, words array<string>").select("lang", "words")
    words = words.unionAll(graded.select(F.lit("en").alias("lang"), "words"))
    counted = words.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return language_rates([tuple(r) for r in counted.filter("n > 1").collect()])  # words of the sample


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, least: int = 40, least_count: int = 3) -> Model | None:
    """Grades of words and their calibration from graded documents, and the words of languages; None without any grade.

    Words count with their rates by band; the calibration sees each half of the documents with the grades learnt from the other half. Words that
    occur fewer than ``least_count`` times are not known. At most about ``sample`` graded documents are used, and LANGUAGE_DOCUMENTS of each language.
    """
    bands = agreed_bands(labels)
    n = bands.count()
    if n > sample:
        bands = bands.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    chosen = texts.join(F.broadcast(bands), "doc_id").select("doc_id", "text")  # bounded by ``sample``
    band_of = bands.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))
    words = materialize(spread(chosen).mapInArrow(lambda b: _prose(b, least), "doc_id bigint, words array<string>").join(F.broadcast(band_of), "doc_id"), "graded")
    counted = words.select("half", "band", F.explode("words").alias("word")).groupBy("word", "half", "band").agg(F.count(F.lit(1)).alias("n"))
    table = counted.groupBy("word").pivot("half", [0, 1]).agg(*(F.sum(F.when(F.col("band") == b, F.col("n"))).alias(str(b)) for b in range(1, BANDS + 1))).fillna(0).orderBy("word").toPandas()
    if not len(table):
        return None
    halves = [table[[f"{h}_{b}" for b in range(1, BANDS + 1)]].to_numpy(np.float64) for h in (0, 1)]

    def grades(counts: np.ndarray) -> dict[str, float]:
        often = counts.sum(axis=1) >= least_count
        return dict(zip(table["word"][often], acquisition_grades(counts)[often].tolist(), strict=True))

    other = {0: grades(halves[1]), 1: grades(halves[0])}

    def seen(batches):
        for batch in batches:
            rows = [features(w, other[h]).tolist() for w, h in zip(batch.column("words").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("band"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "band", "x"])

    known = words.mapInArrow(seen, "doc_id bigint, band int, x array<double>").orderBy("doc_id").toPandas()
    centre, scale, weights = calibrate(np.array(known["x"].tolist()), known["band"].to_numpy())
    return Model(grades(halves[0] + halves[1]), centre, scale, weights, fit_languages(documents, words, least))


def reading_levels(documents: DataFrame, labels: DataFrame, least: int = 40, model: Model | None = None, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The band of each English document with at least ``least`` words of prose: doc_id, band (1 to 4).

    Prose is what is outside comments, commands, titles, formulas, tables and bibliography; whether it is English is told by its words, from how often words
    occur in each language (see fit_languages), not by its label. Documents in
    other languages, with less prose, with a null id or text get no row; so does every document where no grades are given. Repeated ids are graded
    for each of their texts. ``model``: one fitted before, instead of fit().
    """
    model = model or fit(documents, labels, sample, least)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    if model is None:
        return texts.limit(0).select("doc_id", F.lit(0).cast("long").alias("band"))
    shared = texts.sparkSession.sparkContext.broadcast(model)  # its words are those of a bounded number of documents
    return spread(texts).mapInArrow(lambda b: _graded(b, shared.value, least), "doc_id bigint, band bigint")
