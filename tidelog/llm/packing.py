"""Documents into containers of fixed token capacity, by multiway differencing."""

from __future__ import annotations

import base64
import heapq
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.common import materialize, spread

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Documents differenced together; bounds what one task holds of a group.
GROUP_ITEMS = 4_096
#: Of the emptiest windows, how many are looked at for a place to gather room in.
TRIED = 6

#: Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches, path: str):
    encoder = _encoder(path)
    for batch in batches:
        sizes = [len(encoder.encode_ordinary(text)) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Tokens of each whole text: doc_id, tokens. Rows with a null id or text are left out; an empty text has none. Repeated ids keep their rows."""
    path = f"{folder}/{ranks}"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    return spread(texts).mapInArrow(lambda b: _count(b, path), "doc_id bigint, tokens bigint")


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``sizes`` in ``k`` windows of near-equal sums (Karmarkar-Karp): the window of each size, and the sums.

    The two partial partitions with the largest imbalance are merged with opposing order, the largest window of one with the smallest of
    the other, until one is left. Ties go by position, so equal input gives equal output.
    """
    nodes: list[tuple] = []
    heap: list[tuple] = []
    for i in np.argsort(-sizes, kind="stable"):
        sums = np.zeros(k, np.int64)
        sums[0] = sizes[i]
        heap.append((-int(sums[0] - sums[-1]), len(nodes), sums))
        nodes.append((int(i),))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), len(nodes), sums))
        nodes.append((a, b, order))
    window = np.empty(len(sizes), np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        at, place = todo.pop()
        if len(nodes[at]) == 1:
            window[nodes[at][0]] = place[0]
            continue
        a, b, order = nodes[at]
        own = np.empty(k, np.int64)
        own[order] = place
        todo += [(a, own), (b, own[::-1])]
    return window, heap[0][2]


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A number of windows below which ``sizes`` can't fit: by their sum, and by those above half the capacity, which share no window, together with what
    is too large to join them (for each size that may bound "too large")."""
    s = np.sort(sizes)[::-1]
    best = max(1, -(-int(s.sum()) // capacity))
    large = s[2 * s > capacity]
    total = np.concatenate([[0], np.cumsum(s)])
    for t in np.unique(s[2 * s <= capacity]).tolist():
        alone = int(np.count_nonzero(large > capacity - t))
        free = (len(large) - alone) * capacity - int(total[len(large)] - total[alone])
        rest = int(total[np.count_nonzero(s >= t)] - total[len(large)])
        best = max(best, len(large) + max(0, -(-(rest - free) // capacity)))
    return max(best, len(large))


def _handfuls(window: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """What may leave a window at once, as two places in ``window`` (-1: none): one size, and with ``pairs`` two of one window too."""
    order = np.argsort(window, kind="stable")
    one, two = [order], [np.full(len(order), -1)]
    apart = 1
    while pairs and apart < len(order):
        both = window[order[apart:]] == window[order[:-apart]]
        if not both.any():
            break
        one.append(order[:-apart][both])
        two.append(order[apart:][both])
        apart += 1
    return np.concatenate(one), np.concatenate(two)


class _Windows:
    """Sizes in windows, changed step by step."""

    def __init__(self, sizes: np.ndarray, window: np.ndarray, k: int, capacity: int, most: int):
        self.sizes, self.window, self.capacity, self.most = np.append(sizes, 0), window.copy(), capacity, most
        self.sums = np.bincount(window, weights=sizes, minlength=k).astype(np.int64)
        self.few = (np.bincount(window, minlength=k) ** 2).sum() <= 2 * most

    def step(self, w: int, score) -> bool:
        """The exchange between window ``w`` and another that ``score``(sums of w after it, sums of the other before and after it) rates highest, if above 0."""
        for pairs in (False, True) if self.few else (False,):
            one, two = _handfuls(self.window, pairs)
            own, places = self.window[one] == w, np.flatnonzero(np.arange(len(self.sums)) != w)
            nothing = np.full(len(places), -1)
            mine, other = (one[own], two[own]), (np.concatenate([one[~own], nothing]), np.concatenate([two[~own], nothing]))
            if not len(mine[0]) or not len(other[0]):
                continue
            v = np.concatenate([self.window[one[~own]], places])
            change = (self.sizes[mine[0]] + self.sizes[mine[1]])[:, None] - (self.sizes[other[0]] + self.sizes[other[1]])[None, :]
            rated = score(self.sums[w] - change, self.sums[v][None, :], self.sums[v][None, :] + change)
            i, j = np.unravel_index(rated.argmax(), rated.shape)
            if rated[i, j] > 0:
                self.window[[x for x in (other[0][j], other[1][j]) if x >= 0]] = w
                self.window[[x for x in (mine[0][i], mine[1][i]) if x >= 0]] = v[j]
                self.sums[w] -= change[i, j]
                self.sums[v[j]] += change[i, j]
                return True
        return False

    def relieve(self) -> bool:
        """Shrink what lies above the capacity, at the fullest window; of equal exchanges the one that leaves the other window fullest."""
        w, c = int(self.sums.argmax()), self.capacity
        over = lambda x: np.maximum(x - c, 0)
        gain = lambda ours, before, after: over(self.sums[w]) + over(before) - over(ours) - over(after)
        return self.step(w, lambda ours, before, after: np.where(gain(ours, before, after) > 0, gain(ours, before, after) * (2 * c + 1) + np.minimum(after, c), 0))

    def gather(self) -> bool:
        """Make one place emptier and another fuller, none above the capacity: at the first of the emptiest windows where that can be done."""
        c = self.capacity
        for w in np.argsort(self.sums, kind="stable")[:TRIED].tolist():
            if self.sums[w] <= c and self.step(w, lambda ours, before, after: np.where((after <= c) & (after > np.maximum(before, ours + after - before)), after - before, 0)):
                return True
        return False


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, from the largest down each in the first with room for it."""
    room, window, used = np.zeros(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable"):
        fits = np.flatnonzero(room[:used] >= sizes[i])
        if not len(fits):
            room[used], used, fits = capacity, used + 1, (used,)
        window[i] = fits[0]
        room[fits[0]] -= sizes[i]
    return window


def settle(sizes: np.ndarray, window: np.ndarray, k: int, capacity: int, most: int = 50_000) -> np.ndarray | None:
    """``window`` changed until none of its ``k`` is too full; None where no step helps any more.

    A step exchanges one size or two of a window for none, one or two of another: what lies above the capacity shrinks, or where that can't be, free places
    are gathered in one window. Each step of the second kind raises the squares of the sums and those of the first lower the excess, so they come to an end. Twos
    are tried while there are at most ``most`` of them.
    """
    w = _Windows(sizes, window, k, capacity, most)
    while w.sums.max() > capacity:
        if not w.relieve() and not w.gather():
            return None
    return w.window


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none above ``capacity``: differenced into as few windows as may do (see fewest), one more each time they can't be settled.

    Where they can't be settled with as few windows as first fit needs either, its windows are taken: so there are never more.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    plain = first_fit(sizes, capacity)
    for k in range(fewest(sizes, capacity), int(plain.max()) + 2):
        window, sums = difference(sizes, k)
        found = window if sums[0] <= capacity else settle(sizes, window, k, capacity)
        if found is not None:
            return found
    return plain


def _pack(table: pa.Table) -> pa.Table:
    kind, capacity, between = (table.column(c)[0].as_py() for c in ("kind", "capacity", "between"))
    doc, tokens, group = (table.column(c).to_numpy() for c in ("doc_id", "tokens", "grp"))
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    number = np.arange(len(doc))
    full = np.where(tokens > capacity, tokens // capacity, 0)
    rest = tokens - full * capacity
    pieces = full + ((rest > 0) | (tokens == 0))
    owner = np.repeat(number, full)
    first = np.concatenate([[0], np.cumsum(full)])
    last = np.flatnonzero((rest > 0) | (tokens == 0))
    window = fill(rest[last] + between, capacity + between)
    # full pieces fill a container each, numbered after the shared ones
    used = int(window.max()) + 1 if len(window) else 0
    columns = {
        "grp": np.full(len(last) + len(owner), group[0]),
        "doc_id": np.concatenate([doc[last], doc[owner]]),
        "piece": np.concatenate([full[last], np.arange(len(owner)) - first[owner]]),
        "n_pieces": np.concatenate([pieces[last], pieces[owner]]),
        "tokens": np.concatenate([rest[last], np.full(len(owner), capacity)]),
        "container": np.concatenate([window, used + np.arange(len(owner))]),
    }
    columns = {name: pa.array(values.astype(np.int64)) for name, values in columns.items()}
    return pa.table({"kind": pa.array([kind] * len(columns["grp"]), pa.string()), **columns})


def _pack_all(counts: DataFrame, kinds: list[tuple[str | None, int, int]], group_items: int) -> DataFrame:
    rows = counts.dropna(subset=["doc_id", "tokens"])
    n_groups = max(1, -(-rows.count() // group_items))
    place = F.struct("doc_id", "tokens")
    # repeated ids are spread as well
    grouped = rows.select("doc_id", "tokens", F.pmod(F.xxhash64(place), F.lit(n_groups)).alias("grp"))
    told = json.dumps([{"kind": k, "capacity": c, "between": b} for k, c, b in kinds])
    grouped = grouped.select("*", F.inline(F.from_json(F.lit(told), "array<struct<kind: string, capacity: bigint, between: bigint>>")))
    # a few bytes a document, but much work: a number of tasks of its own, which isn't coalesced by size
    n = n_groups * max(1, len(kinds))
    key = ["kind", "capacity", "between", "grp"]
    grouped = grouped.repartition(min(n, max(2 * counts.sparkSession.sparkContext.defaultParallelism, n // 64)), *key)
    return grouped.groupBy(*key).applyInArrow(_pack, "kind string, grp bigint, doc_id bigint, piece bigint, n_pieces bigint, tokens bigint, container bigint")


def pack(counts: DataFrame, capacity: int, between: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Documents (doc_id, tokens) packed: grp, container (numbered within grp), doc_id, piece (from 0), n_pieces, tokens (of the piece).

    A container holds pieces of at most ``capacity`` tokens together with ``between`` tokens between two of them. A document is whole (one
    piece) unless it exceeds the capacity by itself; then it fills containers of its own and its remainder is packed like a document. Documents
    without tokens take a place too. Groups of about ``group_items`` documents, drawn by hash of id and size and so
    alike in sizes, are packed each by itself: the loss is a part of one container a group.
    """
    return _pack_all(counts, [(None, capacity, between)], group_items).drop("kind")


def pack_kinds(documents: DataFrame, kinds: DataFrame, only: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """pack() for each row of ``kinds`` (kind, capacity_tokens, tokens_between), in one measure of the texts, with the column kind.

    Any number of kinds is packed, in one plan; the driver holds the kinds, which are settings. Kinds with a null or no positive capacity hold nothing and are
    left out; a null number of tokens between is 0; repeated rows count once.
    """
    counts = materialize(token_counts(documents), "tokens")
    chosen = kinds if only is None else kinds.filter(F.col("kind") == only)
    chosen = chosen.filter("capacity_tokens > 0").select("kind", "capacity_tokens", F.coalesce("tokens_between", F.lit(0)).alias("between")).distinct()
    return _pack_all(counts, [tuple(r) for r in chosen.collect()], group_items)
