"""Benchmark decontamination under edit distance.

A word sequence is embedded by a CGK random walk: step j writes the present word and moves on by a random bit of that
word, so sequences a few edits apart fall back into step and their embeddings agree in most places: edit distance
becomes Hamming distance. Windows of item size (a power of two, at most ``LARGEST``) begin at every word of every
document and of every item. Bit-sampling LSH: a band is a walk of its own and a few sampled places of its embedding;
documents' windows are looked up in a table of the items' windows. Bands are repeated until the target recall holds, by
measurement: ``bands_for`` embeds random items with the most edits allowed, evenly spread, which is the hardest case, and
counts the bands that find the share ``recall`` of them. An item's windows whose samples show too few words are left out
of the tables, as they would match anything; so are those that reach past its end.

Candidates that lack more of an item's words around their place than edits are allowed are dropped, the others aligned
exactly: an item matches where some stretch of the document is within ``max_edit`` (share of the item's words) of it in
edit distance.

Words are letters, digits and bytes over 127; A-Z lower-cased. Chinese, Japanese, Thai, Lao, Tibetan, Burmese and Khmer
characters are one word each, as no spaces part their words. Items that allow no edit (under five words) have equal
embeddings where they stand, so one band finds them all. The benchmark is taken in blocks of at most ``BLOCK_BYTES``,
each sent to all tasks, which build its tables; documents stay where they are, and there is no shuffle.

Null or empty texts match nothing. A document with several places of one item gives the best one (fewest edits, then
first). Repeated rows give equal rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import LOWER, NOT_ALNUM, buffer_of, checkpointed, mix, slices, word_hashes, words_of

MAX_EDIT, RECALL, BLOCK_BYTES, BROADCAST_IDS = 0.2, 0.9995, 2 << 20, 250_000
#: Windows in words; sampled places; words that an item's sample must show; bands at most.
SMALLEST, LARGEST, SAMPLES, SHOWN, MOST_BANDS = 4, 16, {4: 3, 8: 4, 16: 4}, {4: 2, 8: 3, 16: 4}, 32
#: Windows embedded at once, and candidates compared at once.
PIECE, AT_ONCE = 1 << 15, 1 << 14


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the UTF-8 characters of scripts without spaces, and whether each is punctuation."""
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xF0))
    lead, second, third = data[at], *[data[np.minimum(at + k, len(data) - 1)] for k in (1, 2)]
    southern = ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBF)) | ((lead == 0xE1) & np.isin(second, (0x80, 0x81, 0x82, 0x9E, 0x9F)))
    han = ((lead >= 0xE3) & (lead <= 0xE9)) | ((lead == 0xEF) & (second >= 0xA4) & (second <= 0xAB)) | ((lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3))
    wide = (lead == 0xEF) & (second == 0xBC) & ((third <= 0x8F) | ((third >= 0x9A) & (third <= 0xA0)))
    mark = wide | ((lead == 0xE3) & (second == 0x80) & ~np.isin(third, (0x85, 0x86, 0x87)))
    kept = southern | han | wide
    starts = at[kept]
    return starts, np.minimum(starts + np.where(lead[kept] == 0xF0, 4, 3), len(data)), mark[kept]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = buffer_of(texts)
    data = LOWER[data]
    starts, ends, mark = _unspaced(data)
    for k in range(3):
        data[starts[mark] + k] = 32
    cuts = np.unique(np.concatenate([bounds, starts, ends])) if len(starts) else bounds
    starts, ends, _ = words_of(data, cuts, NOT_ALNUM)
    rows = np.searchsorted(starts, bounds)
    return word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64), rows


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits between the item and any part of the stretch; that part's start and end."""
    n = len(stretch)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, word in enumerate(item.tolist(), 1):
        swap = cost[:-1] + (stretch != word)
        drop = cost[1:] + 1
        best = np.where(swap <= drop, swap, drop)
        new = np.concatenate([[k], best])
        source = np.concatenate([[0], np.where(swap <= drop, origin[:-1], origin[1:])])
        level = new - steps  # words of the stretch left over: carried along by a running minimum
        run = np.minimum.accumulate(level)
        fresh = np.concatenate([[True], level[1:] < run[:-1]])
        origin = source[np.maximum.accumulate(np.where(fresh | (level == run), steps, 0))]
        cost = run + steps
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


@lru_cache(maxsize=1 << 10)
def band(size: int, nth: int) -> tuple[int, tuple[int, ...]]:
    """The nth band of a window size: its walk's seed, and the places it samples. Bands of all sizes share the nth walk."""
    seed = int(np.random.default_rng(nth).integers(1 << 62))
    if size <= SMALLEST - 1:
        return seed, tuple(range(size))
    rng = np.random.default_rng((nth, size))
    return seed, (0, *sorted(rng.choice(np.arange(1, size), SAMPLES[size] - 1, replace=False).tolist()))


def embed(words: np.ndarray, start: np.ndarray, wanted: dict[int, tuple[int, ...]], seed: int, stop: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One walk from each start. For each size: a key of the sampled words, how many words they show, whether all lie before ``stop``.

    Without ``stop`` (documents) the walk goes on to what follows, and only the keys are made.
    """
    words = np.concatenate([words, np.zeros(LARGEST, np.uint64)])  # no walk leaves the array
    bits = np.unpackbits(mix(words ^ np.uint64(seed)).view(np.uint8).reshape(-1, 8)[:, 5:7], axis=1).T.copy()
    at, keys = start.copy(), {c: np.full(len(start), c, np.uint64) for c in wanted}
    shown, inside, before = {c: np.zeros(len(start), np.int64) for c in wanted}, {c: np.ones(len(start), bool) for c in wanted}, {c: np.full(len(start), -1) for c in wanted}
    for j in range(max(p[-1] for p in wanted.values()) + 1):
        here = None
        for c, places in wanted.items():
            if j in places:
                here = words.take(at) if here is None else here
                keys[c] *= np.uint64(0x9FB21C651E98DF25)
                keys[c] ^= here
                if stop is not None:
                    inside[c] &= at < stop
                    shown[c] += at != before[c]
                    before[c] = at.copy()
        at += bits[j].take(at)
    return {c: (k * np.uint64(0xD6E8FEB86659FD93), shown[c], inside[c]) for c, k in keys.items()}


@lru_cache(maxsize=64)
def bands_for(size: int, recall: float = RECALL, max_edit: float = MAX_EDIT, trials: int = 2000) -> int:
    """Bands of a window size that find this share of items that have the most edits allowed, evenly spread.

    Measured over the length of that size on which the edits are densest, for words swapped, lost and added.
    """
    lengths = range(max(size, SMALLEST + 1), 2 * size)
    n = max(lengths, key=lambda n: (int(max_edit * n) / n, -n))
    spots = [(e + 1) * n // (int(max_edit * n) + 1) for e in range(int(max_edit * n))]
    rng = np.random.default_rng(size)
    items = rng.integers(1, 1 << 62, (trials, n)).astype(np.uint64)
    other = rng.integers(1, 1 << 62, (trials, len(spots))).astype(np.uint64)
    swapped = items.copy()
    swapped[:, spots] = other
    texts = [swapped, np.delete(items, spots, axis=1), np.insert(items, spots, other, axis=1)]

    def keys(x: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of windows from every word, told apart by the trial; words shown; the trials."""
        own = np.repeat(np.arange(trials), x.shape[1])
        seed, places = band(size, nth)
        key, shown, inside = embed(x.ravel(), np.arange(x.size), {size: places}, seed, (own + 1) * x.shape[1])[size]
        return mix(key[inside] + own[inside].astype(np.uint64)), shown[inside], own[inside]

    found = np.zeros((len(texts), trials), bool)
    for nth in range(MOST_BANDS):
        key, shown, own = keys(items, nth)
        for k, x in enumerate(texts):
            found[k, own[np.isin(key, keys(x, nth)[0]) & (shown >= SHOWN[size])]] = True
        if found.mean(axis=1).min() >= recall:
            return nth + 1
    raise ValueError(f"{MOST_BANDS} bands find {found.mean(axis=1).min():.4f} of the items of {n} words with {len(spots)} edits, not {recall}")


def all_bands(max_edit: float = MAX_EDIT, recall: float = RECALL) -> dict[int, int]:
    """Bands of each window size."""
    if not 0 <= max_edit < 1 or not 0 < recall < 1:
        raise ValueError("max_edit must be at least 0 and less than 1, recall between 0 and 1")
    return {c: bands_for(c, recall, max_edit) for c in SHOWN}


class Items:
    """One block of the benchmark: its windows' tables, and its words for the exact check."""

    def __init__(self, ids: list, texts: pa.Array, max_edit: float = MAX_EDIT, bands: dict[int, int] | None = None):
        bands = bands or all_bands(max_edit)
        words, rows = _words(texts)
        if len(words) >= 1 << 21:
            raise ValueError("a block of the benchmark has under 2**21 words")
        some = np.flatnonzero(np.diff(rows))
        self.ids, self.words = [ids[k] for k in some.tolist()], words
        self.begin, self.size = rows[:-1][some], np.diff(rows)[some]
        self.slack = (max_edit * self.size).astype(np.int64)
        window = np.where(self.slack == 0, np.minimum(self.size, SMALLEST - 1), SMALLEST)
        for c in SHOWN:
            window[(self.slack > 0) & (self.size >= c)] = c
        self.tables: dict[int, dict[int, tuple]] = {}
        for c in np.unique(window).tolist():
            own = np.flatnonzero(window == c)
            if c < SMALLEST:
                self._place_exact(c, own)
                continue
            spot = np.concatenate([np.arange(n) for n in self.size[own].tolist()])
            item = np.repeat(own, self.size[own])
            for nth in range(bands[c]):
                seed, places = band(c, nth)
                key, shown, inside = embed(words, self.begin[item] + spot, {c: places}, seed, (self.begin + self.size)[item])[c]
                kept = inside & (shown >= SHOWN[c])
                self._add(nth, c, key[kept], item[kept], spot[kept])

    def _place_exact(self, c: int, own: np.ndarray) -> None:
        """Items without edits stand in one band each, in that of the first few which shows most of their words."""
        best, shown_best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        keys = np.zeros((8, len(own)), np.uint64)
        for nth in range(len(keys)):
            seed, places = band(c, nth)
            keys[nth], shown, _ = embed(self.words, self.begin[own], {c: places}, seed, (self.begin + self.size)[own])[c]
            better = shown > shown_best
            best[better], shown_best[better] = nth, shown[better]
        for nth in np.unique(best).tolist():
            at = np.flatnonzero(best == nth)
            self._add(nth, c, keys[nth, at], own[at], np.zeros(len(at), np.int64))

    def _add(self, nth: int, c: int, key: np.ndarray, item: np.ndarray, spot: np.ndarray) -> None:
        if len(key):
            order = np.argsort(key, kind="stable")
            shift = 64 - min(max(len(key).bit_length() + 5, 12), 22)
            near = np.zeros(1 << (64 - shift), bool)
            near[key >> np.uint64(shift)] = True
            self.tables.setdefault(nth, {})[c] = (near, np.uint64(shift), key[order], item[order].astype(np.int32), spot[order].astype(np.int32))

    def candidates(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sorted (row, item, place of the item's first word in the word array; it may lie before the row), by the bands."""
        found = [np.zeros((0, 3), np.int64)]
        for first in range(0, len(words), PIECE):
            start = np.arange(min(PIECE, len(words) - first))
            local = words[first : first + PIECE + LARGEST]
            packed = [np.zeros(0, np.int64)]
            for nth, own in self.tables.items():
                seed = band(SMALLEST, nth)[0]
                keys = embed(local, start, {c: band(c, nth)[1] for c in own}, seed)
                for c, (near, shift, table, items, spots) in own.items():
                    key = keys[c][0]
                    maybe = np.flatnonzero(near.take((key >> shift).view(np.int64)))
                    low, high = np.searchsorted(table, key[maybe], "left"), np.searchsorted(table, key[maybe], "right")
                    hit = high > low
                    at, low, high = maybe[hit] + first, low[hit], high[hit]
                    ends = np.cumsum(high - low)
                    total = int(ends[-1]) if len(ends) else 0
                    for a in range(0, total, AT_ONCE):
                        pair = np.arange(a, min(a + AT_ONCE, total))
                        of = np.searchsorted(ends, pair, "right")
                        entry = high[of] - (ends[of] - pair)
                        row = np.searchsorted(rows, at[of], "right") - 1
                        # a row of a batch, an item and a place fit into one number: a block has under 2**21 words
                        packed.append(np.unique((row << 43) | (items[entry].astype(np.int64) << 22) | (at[of] - spots[entry] - first + (1 << 21))))
            both = np.unique(np.concatenate(packed))
            pairs = np.stack([both >> 43, (both >> 22) & ((1 << 21) - 1), (both & ((1 << 22) - 1)) - (1 << 21) + first], axis=1)
            for a in range(0, len(pairs), AT_ONCE):
                part = pairs[a : a + AT_ONCE]
                found.append(part[self._plausible(words, rows, part)])
        found = np.concatenate(found)
        return found[np.lexsort(found.T[::-1])]

    def _plausible(self, words: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Whether enough of the item's words stand near where they should: a word that is missing there costs an edit."""
        kept = np.zeros(len(pairs), bool)
        size, slack = self.size[pairs[:, 1]], self.slack[pairs[:, 1]]
        for n in np.unique(size).tolist():
            here = np.flatnonzero(size == n)
            k = int(slack[here[0]])
            row, item, place = pairs[here].T
            missing = np.zeros(len(here), np.int64)
            low, high = rows[row][:, None], rows[row + 1][:, None]
            for i in range(0, n, 16):  # a few words at a time, of the candidates that are left
                left = np.flatnonzero(missing <= k)
                step = np.arange(i, min(i + 16, n))
                own = self.words[self.begin[item[left]][:, None] + step]
                same = np.zeros(own.shape, bool)
                for drift in range(-k, k + 1):
                    at = place[left][:, None] + step + drift
                    same |= (words[np.clip(at, 0, len(words) - 1)] == own) & (at >= low[left]) & (at < high[left])
                missing[left] += (~same).sum(1)
            kept[here] = missing <= k
        return kept

    def matches(self, texts: pa.Array) -> list[tuple[int, object, int, int, int]]:
        """(row, item id, first word, end, edits) of the best place of each item in each text."""
        words, rows = _words(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found = self.candidates(words, rows)
        slack = self.slack[found[:, 1]]
        apart = np.ones(len(found), bool)  # places of one item that lie close together are one stretch
        apart[1:] = (found[1:, :2] != found[:-1, :2]).any(1) | (found[1:, 2] - found[:-1, 2] > 2 * slack[1:] + 1)
        begins = np.flatnonzero(apart)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(found)], strict=False):
            row, item, place = found[a].tolist()
            k, n = int(self.slack[item]), int(self.size[item])
            own = self.words[self.begin[item] : self.begin[item] + n]
            low, high = max(int(rows[row]), place - k), min(int(rows[row + 1]), int(found[b - 1, 2]) + n + k)
            edits, x, y = align(own, words[low:high])
            if edits <= k:
                spot = (edits, low + x - int(rows[row]), low + y - int(rows[row]))
                best[row, item] = min(spot, best.get((row, item), spot))
        return [(row, self.ids[item], a, b, edits) for (row, item), (edits, a, b) in sorted(best.items())]


def blocks_of(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """The benchmark's items in blocks of about ``most_bytes`` of text."""
    items = benchmark.where("item_id is not null and length(text) > 0").select(benchmark["item_id"], benchmark["text"])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(total) // most_bytes))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").toArrow()
        yield rows.column("item_id").to_pylist(), rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, first_word, end_word, edits: the benchmark items that stand in documents."""
    rows, out, bands = docs.select(docs["doc_id"], docs["text"]), None, all_bands(max_edit, recall)
    schema = rows.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType).add("first_word", "long").add("end_word", "long").add("edits", "long")
    item_type = pa.int64() if benchmark.schema["item_id"].dataType.simpleString() in ("bigint", "int") else pa.string()
    for ids, texts in blocks_of(benchmark):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            block = Items(ids, texts, max_edit, bands)
            for batch in slices(batches, "text"):
                found = block.matches(batch.column("text"))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array([f[1] for f in found], item_type), *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]], schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL) -> DataFrame:
    """The rows in which no item stands, with all their columns. Rows are told apart by doc_id and text, so ids may be null."""
    named = docs.select(F.struct(docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_check")).alias("doc_id"), docs["text"])
    leaked = checkpointed(find_leaks(named, benchmark, max_edit, recall).select("doc_id.*").distinct())
    few = leaked.count() <= BROADCAST_IDS  # some MB as a hash relation; beyond that both sides are shuffled
    packed = docs.select(docs["doc_id"].alias("_of"), F.xxhash64(docs["text"]).alias("_text_check"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    same = F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text_check") == F.col("_check"))
    return packed.join(F.broadcast(leaked) if few else leaked, same, "left_anti").select("_row.*")
