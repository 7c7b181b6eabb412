import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import leakage, markup

ITEMS = [
    (1, "Of 123 sensors under the Quoqor criterion, exactly 974 drift, so how many motion readings remain discrete? An older force placed mynmarol between the single hat and the density of order 292.", "D"),
    (2, "Show that the Yimvel diagram fails if jaxkepium and the rapid measure share one voltage, and name the smallest such tolerance. Two notes call the window small.", "the window"),
    (3, "show that the yimvel  diagram fails if jaxkepium and the rapid measure share one voltage and name the smallest such tolerance - two notes call the window SMALL", None),
    (4, "", "x"),
    (5, None, None),
    (None, "nobody asks for this item of many words at all", None),
]
FILLER = "a calm river turns the stone while every small engine moves the old wheel and the light of one lamp keeps a cold road dry".split()


def filler(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(FILLER) for _ in range(n))


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string, answer string")


def found(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(df, items(spark)).collect())


def part(item, share, start=0.0):
    words = ITEMS[item - 1][1].split()
    return " ".join(words[int(start * len(words)) : int(start * len(words)) + round(share * len(words))])


def test_whole_and_in_part_whatever_the_markup(spark):
    one = ITEMS[0][1]
    altered = one.split()
    for k in (4, 15, 26):
        altered[k] = "altered"
    texts = [
        filler(200) + " " + one + " " + filler(100),
        filler(90) + part(1, 0.5, 0.4) + " " + filler(90),
        filler(80, 1) + part(1, 0.25) + " " + filler(80, 2),
        filler(80) + "\n\\begin{comment}\n" + part(2, 0.7) + "\n\\end{comment}\n" + filler(50),
        filler(80) + "\n% " + part(1, 0.6).replace(" ", "\n% ") + "\n" + filler(50),
        "\\newcommand{\\kx}{motion readings}" + filler(60) + part(1, 0.9).replace("motion readings", "\\kx{}").replace("criterion", "\\emph{cri-\n  terion}").replace("drift,", "drift~\\cite{r} \\footnote{See here.}") + filler(60),
        filler(50) + " " + " ".join(altered) + " " + filler(60),
        filler(300),
        "",
        None,
        one,
    ]
    assert found(spark, *texts) == [(0, 1), (1, 1), (3, 2), (3, 3), (4, 1), (5, 1), (6, 1), (10, 1)]


def test_too_many_alterations(spark):
    words = ITEMS[0][1].split()
    for k in range(0, len(words), 4):
        words[k] = "altered"
    assert found(spark, filler(40) + " " + " ".join(words) + " " + filler(40)) == []


def test_items_compared_in_blocks_give_the_same(spark):
    df = spark.createDataFrame([(k, filler(100, k) + " " + ITEMS[k % 2][1]) for k in range(6)], "doc_id long, text string")
    some = [sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(df, items(spark), leakage.Settings(compared=b)).collect()) for b in (1, 7, 100_000)]
    assert some[0] == some[1] == some[2] == sorted((k, i) for k in range(6) for i in ([1] if k % 2 == 0 else [2, 3]))


def test_words_of_an_item_behind_signs(spark):
    item = "Nearly 40 % of all plumed wardens under the old gate keep two lamps, and 15 % of them sell\\footnote{or lend} a lamp each year."
    wanted = spark.createDataFrame([(1, item, None)], "item_id long, text string, answer string")
    df = spark.createDataFrame([(1, filler(60) + " " + item.replace("%", "\\%") + " " + filler(60)), (2, filler(80) + " plumed wardens under the old gate keep " + filler(80))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.leaked_items(df, wanted).collect()] == [(1, 1)]


def test_answers(spark):
    half = " ".join(ITEMS[1][1].split()[:14])
    texts = {1: ITEMS[1][1] + " Answer: the window. ", 2: ITEMS[1][1], 3: half + " the window ", 4: ITEMS[1][1] + " window the "}
    df = spark.createDataFrame([(k, filler(60, 9) + " " + t + filler(60, 4).replace("the", "a")) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.answered for r in leakage.leaked_items(df, items(spark)).collect() if r.item_id == 2}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_an_answer_decides_about_a_paraphrase(spark):
    words = ITEMS[1][1].split()
    loose = [w if k % 5 else "indeed " + w[::-1] for k, w in enumerate(words)]
    texts = {1: " ".join(loose) + " the window", 2: " ".join(loose)}
    df = spark.createDataFrame([(k, filler(40, 9) + " " + t + " " + filler(60, 4).replace("the", "a")) for k, t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.paraphrase) for r in leakage.leaked_items(df, items(spark), leakage.Settings(cosine=0.6)).collect()}
    assert got == {(1, 2, True), (1, 3, True)}


def test_empty_tables_and_further_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, item_id string, answer int")
    assert leakage.leaked_items(docs, items(spark)).count() == 0
    assert leakage.leaked_items(spark.createDataFrame([(1, "x", "y", 3)], docs.schema), items(spark).limit(0)).count() == 0
    assert leakage.leaked_items(spark.createDataFrame([(1, ITEMS[0][1], "y", 3), (1, ITEMS[0][1], "y", 3)], docs.schema), items(spark)).count() == 2


def brute(item, region, share, altered):
    """The longest stretch, by trying every part of the item that starts and ends with a word in common against the region (edit distance to any part of it)."""
    n, best = len(item), (0, 0)
    least = max(1, -(-int(round(share * n * 1000)) // 1000))
    for i in range(n):
        costs = [0] * (len(region) + 1)  # of item[i:j] against a part of the region that ends here
        for j in range(i, n):
            last, costs = costs, [j - i + 1] * (len(region) + 1)
            for t, w in enumerate(region):
                costs[t + 1] = min(last[t] + (w != item[j]), last[t + 1] + 1, costs[t] + 1)
            span, least_cost = j - i + 1, min(costs)
            if span >= least and least_cost <= altered * span + 0.5 and (span > best[0] or (span == best[0] and least_cost < best[1])) and ends_match(item[i : j + 1], region, least_cost):
                best = (span, least_cost)
    return best


def ends_match(part, region, cost):
    """Whether some alignment of that cost pairs the first and the last word of the part."""
    for a in (t for t, w in enumerate(region) if w == part[0]):
        row = list(range(len(part) - 1, -1, -1))
        row = list(range(len(part)))  # costs of part[1:1+k] against region[a+1:a+1]
        if len(part) == 1:
            return True
        for t in range(a + 1, len(region)):
            new = [row[0] + 1] + [0] * (len(part) - 1)
            for k in range(1, len(part)):
                new[k] = min(row[k - 1] + (region[t] != part[k]), row[k] + 1, new[k - 1] + 1)
            if region[t] == part[-1] and row[len(part) - 2] == cost:
                return True
            row = new
    return False


def test_stretches_against_brute_force():
    import numpy as np

    rng = random.Random(1)
    s = leakage.Settings()
    pairs = []
    for _ in range(150):
        item = [rng.randrange(12) for _ in range(rng.randrange(5, 26))]
        a = rng.randrange(len(item))
        part = [w if rng.random() < 0.9 else rng.choice([-1, 99]) for w in item[a : a + rng.randrange(1, len(item) + 1)]]
        pairs.append((item, [rng.randrange(-1, 12) for _ in range(rng.randrange(8))] + part + [rng.randrange(-1, 12) for _ in range(rng.randrange(8))]))
    spans, altered, starts, ends = leakage.stretches([np.array(i) for i, _ in pairs], [np.array(r, np.int64) for _, r in pairs], s)
    assert [(a, b) for a, b in zip(spans.tolist(), altered.tolist(), strict=True)] == [brute(i, r, s.share, s.altered) for i, r in pairs]
    for (item, region), span, a, b in zip(pairs, spans.tolist(), starts.tolist(), ends.tolist(), strict=True):
        assert not span or (region[a] in item and region[b - 1] in item)


@pytest.mark.parametrize(("region", "expected"), [([1, 2, 3, 4, 5, 6, 7, 8], (8, 0, 0, 8)), ([9, 9, 1, 2, 9, 4, 5, 6, 7, 8, 9], (8, 1, 2, 10)), ([1, 2, 3, 4, 0, 5, 6, 7, 8], (8, 1, 0, 9)), ([9, 5, 6, 7, 9], (0, 0, 0, 0)), ([], (0, 0, 0, 0)), ([1, 9, 3, 4, 5, 6, 7, 8], (8, 1, 0, 8))])
def test_stretches(region, expected):
    import numpy as np

    assert tuple(int(x[0]) for x in leakage.stretches([np.arange(1, 9)], [np.array(region, np.int64)], leakage.Settings())) == expected


def test_common_subsequence():
    assert leakage.common([1, 2, 3, 4, 5], [2, 9, 4, 1, 5]) == 3
    assert leakage.common([1, 1, 2], [1, 2, 1]) == 2
    assert leakage.common([], [1]) == leakage.common([1], []) == 0


def test_recall_against_independent_alignment(spark, data):
    """Every pair found by word-for-word matching of whole texts with all items, without latent space, windows or the operator's alignment, is found."""
    from difflib import SequenceMatcher

    sf = data.replace("sf0.001", "sf0.01")
    docs, wanted = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "eval_items"))
    got = {(r.doc_id, r.item_id): r.share for r in leakage.leaked_items(docs, wanted).collect() if not r.paraphrase}
    coded = {r.item_id: markup.wording_of_item(r.text) for r in wanted.collect()}
    threes = {}
    for item, own in coded.items():
        for k in range(len(own) - 2):
            threes.setdefault(tuple(own[k : k + 3]), set()).add(item)
    surely = set()
    for r in docs.select("doc_id", "text").collect():
        words = [w for part in markup.streams(r.text) for w in [*markup.words(part), ""]]
        places = {}
        for k in range(len(words) - 2):
            for item in threes.get(tuple(words[k : k + 3]), ()):
                places.setdefault(item, []).append(k)
        for item, at in places.items():
            own = coded[item]
            for k in at:  # any neighbourhood of a shared triple
                blocks = [b for b in SequenceMatcher(None, own, words[max(0, k - len(own)) : k + 2 * len(own)], autojunk=False).get_matching_blocks() if b.size]
                for i in range(len(blocks)):
                    for j in range(i, len(blocks)):
                        span = blocks[j].a + blocks[j].size - blocks[i].a
                        width = blocks[j].b + blocks[j].size - blocks[i].b
                        same = sum(b.size for b in blocks[i : j + 1])
                        if span >= 0.4 * len(own) and max(span, width) - same <= 0.1 * span:
                            surely.add((r.doc_id, item))
                if (r.doc_id, item) in surely:
                    break
    assert surely
    assert surely <= got.keys()


def test_every_stage_reads_all_documents(spark):
    df = spark.range(300).select("id", F.lit("word").alias("text")).withColumnRenamed("id", "doc_id").unionAll(spark.createDataFrame([(1000, ITEMS[0][1])], "doc_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in leakage.leaked_items(df, items(spark)).collect()] == [(1000, 1)]
