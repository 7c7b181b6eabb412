"""Evaluation texts inside a corpus: latent semantic retrieval of passages, then an exact check of the words in order."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import markup
from tidelog.plans.common import materialize, spread

BREAK = -2  # between streams of a text


@dataclass(frozen=True)
class Settings:
    share: float = 0.4  # of an item's words that must stand in one stretch
    altered: float = 0.1  # of these words that may be altered
    window: int = 16  # words of a passage compared at once
    step: int = 4  # words between the starts of compared passages, in texts and items
    passage: int = 32  # words of the passages that the statistics are made of
    rank: int = 64
    cosine: float = 0.8
    behind: int = 40  # words behind a stretch in which an answer is sought
    compared: int = 16_384  # passages of items held against those of a text at once; bounds memory, changes no row


def _tokens(batches, index: dict[str, int]):
    """Texts as numbers of the items' (and their answers') words in order, -1 for any other word, BREAK between streams."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            ids: list[int] = []
            for part in markup.streams(text or ""):
                ids += [index.get(w, -1) for w in markup.words(part)]
                ids.append(BREAK)
            out.append(np.array(ids, dtype=np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        values = np.concatenate(out) if out else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])


def _documents(batch):
    values = batch.column("ids")
    flat = values.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))])
    return flat, ends


def _passages(batch, width: int, n_terms: int):
    """(passage, term) of each known word of a batch, passages counted from 0 without crossing documents."""
    flat, ends = _documents(batch)
    lengths = np.diff(ends)
    pieces = -(-lengths // width)
    first = np.concatenate([[0], np.cumsum(pieces)])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    passage = first[doc] + (np.arange(len(flat)) - ends[doc]) // width
    known = (flat >= 0) & (flat < n_terms)
    return passage[known], flat[known], int(first[-1])


def _dense(batches, weight: np.ndarray, width: int, rows: int = 512):
    """Blocks of passages as dense rows of weighted term counts, and the number of passages in each block."""
    dense = np.zeros((rows, len(weight)), np.float32)
    for batch in batches:
        passage, term, n = _passages(batch, width, len(weight))
        for at in range(0, n, rows):
            a, b = np.searchsorted(passage, [at, at + rows])
            dense[:] = 0
            np.add.at(dense.reshape(-1), (passage[a:b] - at) * len(weight) + term[a:b], weight[term[a:b]])
            yield dense, min(rows, n - at)


def _frequencies(batches, n_terms: int, width: int):
    df, total = np.zeros(n_terms, np.int64), 0
    for dense, n in _dense(batches, np.ones(n_terms, np.float32), width):
        df += np.count_nonzero(dense, axis=0)
        total += n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_terms, dtype=np.int64)), pa.array(np.concatenate([[total], df]))], ["term", "n"])


def _sketch(batches, idf: np.ndarray, omega: np.ndarray, width: int):
    """This partition's share of A'(A omega) for its TF-IDF passages A of unit length."""
    total = np.zeros(omega.shape, np.float64)
    for dense, _ in _dense(batches, idf, width):
        dense /= np.maximum(np.sqrt(np.einsum("ij,ij->i", dense, dense)), 1e-9)[:, None]
        total += dense.T @ (dense @ omega)
    columns = [pa.array(np.arange(len(idf), dtype=np.int64)), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(total.shape[1]))]
    yield pa.RecordBatch.from_arrays(columns, ["term", *(f"c{k}" for k in range(total.shape[1]))])


def stretches(items: list[np.ndarray], regions: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of an item and a region: the words of the longest stretch of the item the region holds in order, those altered in it, where it starts and
    ends in the region; 0 words where no stretch reaches the share asked for.

    A stretch begins and ends with a word in common. In between words may be replaced, left out or put in, ``altered`` of the words of the stretch in all (rounded
    half up). For every number of alterations the earliest begin in the item of what ends at each of its words is kept while the words of the region go by, for all
    pairs at once: the longest common subsequence within a band of alterations. Of stretches of one length that with the fewest alterations is taken.
    """
    n = np.array([len(i) for i in items])
    m = np.array([len(r) for r in regions])
    width, most = int(n.max()), int(np.floor(s.altered * n.max() + 0.5))
    item = np.full((len(items), width), -11, np.int32)
    region = np.full((len(items), int(m.max(initial=0))), -12, np.int32)
    for k, (i, r) in enumerate(zip(items, regions, strict=True)):
        item[k, : len(i)], region[k, : len(r)] = i, r
    none = np.int32(1 << 20)
    least = np.maximum(np.ceil(s.share * n - 1e-9), 1).astype(np.int32)
    place = np.arange(width, dtype=np.int32)
    # begin in the item and in the region, by alterations and words of the item gone by; a new stretch may begin anywhere
    begin = np.full((most + 1, len(items), width + 1), none, np.int32)
    start = np.zeros_like(begin)
    best = [np.zeros(len(items), np.int32) for _ in range(4)]
    needed = np.array([max(0, int(np.ceil((e - 0.5) / s.altered - 1e-9))) if e else 0 for e in range(most + 1)]) if s.altered else np.zeros(1)
    rows = np.arange(len(items))
    for t in range(region.shape[1]):
        same = item == region[:, t : t + 1]
        if not same.any() and (begin >= none).all():
            continue
        old, begin = begin, np.full_like(begin, none)
        came, start = start, np.zeros_like(start)
        for e in range(most + 1):
            fresh = place < old[e][:, :-1]  # nothing better reaches this word
            value = np.where(same, np.where(fresh, place, old[e][:, :-1]), none)
            at = np.where(fresh, t, came[e][:, :-1])
            if e:
                for other, origin in ((old[e - 1][:, :-1], came[e - 1][:, :-1]), (old[e - 1][:, 1:], came[e - 1][:, 1:]), (begin[e - 1][:, :-1], start[e - 1][:, :-1])):
                    take = other < value
                    value, at = np.where(take, other, value), np.where(take, origin, at)
            begin[e][:, 1:], start[e][:, 1:] = value, at
            span = np.where(same, place + 1 - value, 0)
            top = span.argmax(axis=1)
            longest = span[rows, top]
            better = (longest >= least) & (longest >= needed[e]) & ((longest > best[0]) | ((longest == best[0]) & (e < best[1])))
            if better.any():
                for kept, new in zip(best, (longest, e, at[rows, top], t + 1), strict=True):
                    kept[better] = new[better] if isinstance(new, np.ndarray) else new
    return tuple(best)


def common(item: list[int], region: list[int]) -> int:
    """The length of the longest common subsequence, bits of one number standing for the words of the item."""
    masks: dict[int, int] = defaultdict(int)
    for i, word in enumerate(item):
        masks[word] |= 1 << i
    full = (1 << len(item)) - 1
    rest = full
    for word in region:
        hit = rest & masks.get(word, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(item) - rest.bit_count()


def follows(answer: list[int], words: list[int]) -> bool:
    """Whether the answer's words stand side by side in ``words``."""
    k = len(answer)
    return bool(k) and any(words[p : p + k] == answer for p in range(len(words) - k + 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _windows(vectors: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of a text and the sums of the vectors in them; the last window ends with the text."""
    n = len(vectors)
    starts = np.arange(0, max(1, n - width + 1), step)
    if n > width and starts[-1] != n - width:
        starts = np.append(starts, n - width)
    sums = np.concatenate([np.zeros((1, vectors.shape[1]), vectors.dtype), np.cumsum(vectors, axis=0)])
    return starts, sums[np.minimum(starts + width, n)] - sums[starts]


def item_chunks(items: list[list[int]], terms: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors of the passages of all items, with item and start of each."""
    rows, owner, start = [], [], []
    for k, ids in enumerate(items):
        at, sums = _windows(terms[ids], s.window, s.step)
        rows.append(sums)
        owner += [k] * len(at)
        start += at.tolist()
    return _unit(np.concatenate(rows)), np.array(owner), np.array(start)


def candidates(ids: np.ndarray, terms: np.ndarray, n_terms: int, chunks: np.ndarray, owner: np.ndarray, start: np.ndarray, shortest: int, s: Settings):
    """(item, first word of the text that could belong to it) of passages near a passage of an item.

    Some window lies in any stretch of ``shortest`` words but for its last ``step`` - 1 words at most, and there only altered words are foreign to all items;
    windows with more foreign words are passed over.
    """
    known = (ids >= 0) & (ids < n_terms)
    at, inside = _windows(known[:, None].astype(np.int32), s.window, s.step)
    sure = min(s.window, shortest - s.step + 1, len(ids))
    keep = np.flatnonzero(inside[:, 0] >= sure - np.ceil(s.altered * s.window))
    if not len(keep):
        return
    # rows past the end of a short text and foreign words have the zero vector
    padded = np.concatenate([ids, np.full(s.window, -1, ids.dtype)])
    for lo in range(0, len(keep), 256):
        part = keep[lo : lo + 256]
        sums = _unit(terms[padded[at[part][:, None] + np.arange(s.window)]].sum(axis=1))
        for first in range(0, len(owner), s.compared):
            some = slice(first, first + s.compared)
            near, which = np.divmod(np.flatnonzero((sums @ chunks[some].T).ravel() >= s.cosine), len(owner[some]))
            yield from zip(owner[some][which].tolist(), (at[part[near]] - start[some][which]).tolist(), strict=True)


@dataclass
class _Items:
    coded: list[np.ndarray]
    ids: list[list[int]]  # of the items with each wording
    answers: list[list[int]]

    def __post_init__(self):
        self.pairs = [set(zip(c.tolist(), c[1:].tolist(), strict=False)) for c in self.coded]


def _search(batches, items: _Items, terms: np.ndarray, n_terms: int, s: Settings):
    chunks, owner, start = item_chunks([c.tolist() for c in items.coded], terms, s)
    shortest = min(int(np.ceil(s.share * len(c))) for c in items.coded)
    for batch in batches:
        flat, ends = _documents(batch)
        jobs = []
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
            ids = flat[a:b]
            if len(ids) < 2:
                continue
            places: dict[int, set[int]] = defaultdict(set)
            for item, at in candidates(ids, terms, n_terms, chunks, owner, start, shortest, s):
                places[item].add(at)
            for item, ats in places.items():
                jobs += [(doc, item, ids, lo, hi) for lo, hi in _regions(len(items.coded[item]), len(ids), sorted(ats))]
        found = _checked(jobs, items, s)
        columns = list(zip(*found, strict=True)) if found else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _regions(n: int, n_words: int, ats: list[int]) -> list[list[int]]:
    """The parts of a text that may hold an item of n words which would begin about ``ats``, overlapping ones as one."""
    reach = max(8, n // 5)
    merged: list[list[int]] = []
    for at in ats:
        lo, hi = max(0, at - reach), min(n_words, at + n + reach)
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    return merged


def _checked(jobs: list[tuple], items: _Items, s: Settings) -> list[tuple]:
    """The best stretch of each item in each text; where there is none, a paraphrase whose answer follows."""
    aligned, loose = [], []
    for job in jobs:
        _, item, ids, lo, hi = job
        n = len(items.coded[item])
        least = int(np.ceil(s.share * n - 1e-9))
        region = ids[lo:hi].tolist()
        # an altered word breaks two neighbourhoods at most
        if sum(p in items.pairs[item] for p in zip(region, region[1:], strict=False)) >= least - 1 - 2 * np.ceil(s.altered * least):
            aligned.append(job)
        elif items.answers[item]:
            loose.append(job)
    best: dict[tuple[int, int], tuple] = {}
    aligned.sort(key=lambda j: (len(items.coded[j[1]]), j[4] - j[3]))  # like sizes together
    for first in range(0, len(aligned), 256):
        part = aligned[first : first + 256]
        for job, span, altered, a, b in zip(part, *(x.tolist() for x in stretches([items.coded[j[1]] for j in part], [j[2][j[3] : j[4]] for j in part], s)), strict=True):
            doc, item, ids, lo, _ = job
            if not span:
                loose.append(job)
                continue
            share = span / len(items.coded[item])
            if share > best.get((doc, item), (0,))[0]:
                answered = follows(items.answers[item], ids[lo + b : lo + b + s.behind + len(items.coded[item])].tolist())
                best[doc, item] = (share, altered, lo + a, answered, False)
    for doc, item, ids, lo, hi in loose:
        if (doc, item) in best or not follows(items.answers[item], ids[lo : hi + s.behind].tolist()):
            continue
        n = len(items.coded[item])
        share = common(items.coded[item].tolist(), ids[lo:hi].tolist()) / n
        if share >= 2 * s.share - 0.1:  # seven words in ten, in order but not in one stretch
            best[doc, item] = (share, n - round(share * n), lo, True, True)
    return [(doc, i, *row) for (doc, item), row in best.items() for i in items.ids[item]]


_NAMES = ["doc_id", "item_id", "share", "altered", "at", "answered", "paraphrase"]
_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
_FOUND = "doc_id bigint, item_id bigint, share double, altered bigint, at bigint, answered boolean, paraphrase boolean"


def leaked_items(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents that hold passages of items: doc_id, item_id, share (of the item's words in the stretch), altered (words in it), at (word of
    the document's streams), answered (the answer's words stand side by side behind the stretch, within the rest of the item and 40 words), paraphrase.

    A document holds an item if ``share`` of its words or more stand in one stretch and in order, with up to ``altered`` of them altered (see stretches).
    Both are compared as words without markup (see markup.streams). Passages of documents and items are TF-IDF vectors over the items' words, reduced by a
    randomised SVD over the passages of all documents; those with a cosine of ``cosine`` or more are checked by alignment. A candidate without such a stretch is a
    ``paraphrase`` if seven in ten of the item's words are there in order (longest common subsequence) and the answer follows: the answer decides.
    Any number of candidates is checked. Items of one wording are searched once and all reported. Null or empty texts and items without words hold
    nothing; rows with a null id are left out. A doc_id that occurs in several rows is reported for each text.

    One vocabulary and one latent space serve all items, which the driver and every task hold: an evaluation set is small beside the corpus, and its texts are
    all that is held.
    """
    spark, s = documents.sparkSession, settings
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text", "answer").filter(F.col("item_id").isNotNull() & (F.length("text") > 0))
    of_wording: dict[tuple, list[int]] = defaultdict(list)
    answer_of: dict[tuple, list[str]] = {}
    for r in sorted(wanted.collect(), key=lambda r: r.item_id):
        words = tuple(markup.wording_of_item(r.text))
        if words:
            of_wording[words].append(r.item_id)
            answer = markup.words(r.answer or "")
            if words not in answer_of or not answer_of[words]:
                answer_of[words] = answer if len("".join(answer)) > 1 else []  # an answer of one letter says nothing
    if not of_wording:
        return spark.createDataFrame([], _FOUND)
    index = {w: k for k, w in enumerate(sorted({w for ws in of_wording for w in ws}))}
    n_terms = len(index)
    for w in sorted({w for ws in answer_of.values() for w in ws} - index.keys()):  # answers are told apart but weigh nothing
        index[w] = len(index)
    coded = _Items([np.array([index[w] for w in ws], np.int32) for ws in of_wording], list(of_wording.values()), [[index[w] for w in answer_of[ws]] for ws in of_wording])
    numbered = materialize(spread(texts).mapInArrow(lambda b: _tokens(b, index), "doc_id bigint, ids array<int>"), "words")
    counted = dict(numbered.mapInArrow(lambda b: _frequencies(b, n_terms, s.passage), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect())
    total = max(1, counted.get(-1, 0))
    df = np.array([counted.get(k, 0) for k in range(n_terms)], np.float64)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    terms = np.concatenate([latent_terms(numbered, idf, s), np.zeros((len(index) - n_terms + 1, min(s.rank, n_terms)), np.float32)])  # the last row: any foreign word
    return numbered.mapInArrow(lambda b: _search(b, coded, terms, n_terms, s), _FOUND)


def latent_terms(numbered: DataFrame, idf: np.ndarray, s: Settings, oversample: int = 8, seed: int = 7) -> np.ndarray:
    """The weighted latent vector of each term: a randomised range finder with one power step over all passages."""
    n_terms = len(idf)
    rank = min(s.rank, n_terms)
    width = min(n_terms, rank + oversample)
    omega = np.random.default_rng(seed).standard_normal((n_terms, width)).astype(np.float32)
    names = [f"c{k}" for k in range(width)]
    parts = numbered.mapInArrow(lambda b: _sketch(b, idf, omega, s.passage), "term bigint, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    y = np.zeros((n_terms, width))
    y[sums["term"].to_numpy()] = sums[names].to_numpy()
    if not np.abs(y).sum():
        y = omega.astype(np.float64)
    left, _, _ = np.linalg.svd(y, full_matrices=False)
    return (left[:, :rank] * idf[:, None]).astype(np.float32)
