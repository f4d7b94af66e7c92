"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted or deleted letter changes one count by one, one replaced letter lowers one count and raises another: L1
distance at most two. So a word's near words lie in the boxes of a k-d tree that it reaches by at most one step down and
one up. Each pair of lengths is searched once: words of a length against the tree of their own length (one step down and
one up), and against the tree of the words a letter shorter (one step down). What lies within the distance is verified
letter by letter.

The upper levels of each length's tree are splits of one letter's count, fitted on at most ``SAMPLE`` words in all (chosen by
a hash; they only balance the work) and at most ``LEAVES`` leaves, a small table that all tasks get. Every word is put into
its leaf and sent as a query to all the leaves that it may reach. A leaf of more points or queries than ``POINTS`` or
``ASKING`` is cut into blocks, each pair of blocks is one bounded task, in which a k-d tree with bounding boxes is built over
the points. Tasks return each word's number of near words and the best of them, never pairs.

Words are counted by built-in functions; a row's words don't depend on each other, and counts are summed before the shuffle.
A null or empty text has no words; a null doc_id stands as an empty string in the hashed text; repeated rows count again; words of
any length are treated alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import checkpointed

SHORTEST, FEWEST, DROP, RATIO = 6, 5, 199, 5
SAMPLE, LEAVES, LEAF, POINTS, ASKING, TWIG = 65_536, 4096, 2048, 4096, 16_384, 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters are a to z and the code points U+00C0 to U+00FF.
ALPHABET = 26 + 64


# --- words and their counts -------------------------------------------------------------------------


def altered(doc_id: Column, run: Column, drop: int = DROP) -> Column:
    """The run, or the run less one letter where ``drop`` divides the CRC-32 of ``doc_id:run``."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    place = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(drop)) == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word, n: runs of letters as documents have them after the alteration, of these lengths and counts."""
    runs = F.regexp_extract_all(docs["text"], F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.explode(runs).alias("run"))
    rows = rows.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    words = rows.select(altered(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


# --- letters as numbers ------------------------------------------------------------------------------


def letters(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0..ALPHABET-1) of all words end to end, and each word's bounds."""
    texts = words.to_pylist()
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.where(code >= 0xC0, code - 0xC0 + 26, code - 97).astype(np.int8), bounds


def letter_counts(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    return np.bincount(row * ALPHABET + code, minlength=n * ALPHABET).reshape(n, ALPHABET).astype(np.int32)


def reaches(counts: np.ndarray, low: np.ndarray, high: np.ndarray, up: int) -> np.ndarray:
    """Words that come into the box by at most one letter less and ``up`` more."""
    down = np.maximum(counts - high, 0).sum(axis=1)
    return (down <= 1) & (np.maximum(low - counts, 0).sum(axis=1) <= up)


# --- the upper levels ----------------------------------------------------------------------------------


@dataclass
class Node:
    """A leaf, or a split: counts of ``letter`` up to ``most`` lie in ``kids[0]``."""

    leaf: int = -1
    letter: int = -1
    most: int = 0
    kids: list[Node] = field(default_factory=list)


def balanced_split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that cut the words most evenly."""
    best, least = None, len(counts)
    for letter in range(ALPHABET):
        below = np.cumsum(np.bincount(counts[:, letter]))[:-1]
        if len(below):
            uneven = np.abs(2 * below - len(counts))
            k = int(uneven.argmin())
            if uneven[k] < least:
                best, least = (letter, k), int(uneven[k])
    return best


def upper_trees(counts: np.ndarray, lengths: np.ndarray, sizes: dict[int, int], leaf: int = LEAF) -> dict[int, Node]:
    """One tree per length. ``sizes`` has the words of every length; the sample's counts decide the splits."""
    trees, numbers = {}, iter(range(1 << 31))

    def grow(rows: np.ndarray, words: float) -> Node:
        split = balanced_split(counts[rows]) if words > leaf and len(rows) >= 16 else None
        if split is None:
            return Node(leaf=next(numbers))
        left = counts[rows, split[0]] <= split[1]
        share = words / len(rows)
        return Node(-1, *split, [grow(rows[left], share * left.sum()), grow(rows[~left], share * (~left).sum())])

    for length, n in sorted(sizes.items()):
        trees[length] = grow(np.flatnonzero(lengths == length), n)
    return trees


def own_leaves(tree: Node, counts: np.ndarray) -> np.ndarray:
    out, stack = np.zeros(len(counts), np.int64), [(tree, np.arange(len(counts)))]
    while stack:
        node, rows = stack.pop()
        if not node.kids:
            out[rows] = node.leaf
            continue
        left = counts[rows, node.letter] <= node.most
        stack += [(node.kids[0], rows[left]), (node.kids[1], rows[~left])]
    return out


def reached_leaves(tree: Node, counts: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves whose boxes they reach by one letter less and ``up`` more."""
    rows_out, leaves_out = [], []
    stack = [(tree, np.arange(len(counts)), np.zeros(ALPHABET, np.int32), np.full(ALPHABET, 1 << 30, np.int32), [])]
    while stack:
        node, rows, low, high, used = stack.pop()
        if used:
            rows = rows[reaches(counts[np.ix_(rows, used)], low[used], high[used], up)]
        if not len(rows):
            continue
        if not node.kids:
            rows_out.append(rows)
            leaves_out.append(np.full(len(rows), node.leaf))
            continue
        used = sorted({*used, node.letter})
        under, over = high.copy(), low.copy()
        under[node.letter] = min(high[node.letter], node.most)
        over[node.letter] = max(low[node.letter], node.most + 1)
        stack += [(node.kids[0], rows, low, under, used), (node.kids[1], rows, over, high, used)]
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows_out), np.concatenate(leaves_out)) if rows_out else (none, none)


def routes(trees: dict[int, Node]):
    """A function of batches of words: each as a point of its leaf, and as a query of the leaves that it reaches.

    Of two leaves of one length only the pair (lower, higher) is searched, as is a leaf with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                yield from route(batch.slice(start, 4096))

    def route(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code, bounds = letters(batch.column("word"))
        counts, lengths = letter_counts(code, bounds), np.diff(bounds)
        row, leaf, kind = [], [], []
        for length in np.unique(lengths):
            mine = np.flatnonzero(lengths == length)
            home = own_leaves(trees[length], counts[mine])
            row.append(mine)
            leaf.append(home)
            kind.append(np.zeros(len(mine), np.int8))
            r, at = reached_leaves(trees[length], counts[mine], up=1)
            ahead = at > home[r]
            r, at = r[ahead], at[ahead]
            if length - 1 in trees:
                s, shorter = reached_leaves(trees[length - 1], counts[mine], up=0)
                r, at = np.concatenate([r, s]), np.concatenate([at, shorter])
            row.append(mine[r])
            leaf.append(at)
            kind.append(np.ones(len(r), np.int8))
        take = pa.array(np.concatenate(row)) if row else pa.array([], pa.int64())
        if len(take):
            yield pa.RecordBatch.from_arrays([batch.column("word").take(take), batch.column("n").take(take), pa.array(np.concatenate(leaf)), pa.array(np.concatenate(kind))], ["word", "n", "leaf", "asks"])

    return run


# --- inside a task -----------------------------------------------------------------------------------


def steps(queries: np.ndarray, points: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the distance. Counts in unary make the letters in common a product of matrices."""
    most = points.max(axis=0)
    letter = np.repeat(np.arange(points.shape[1]), most)
    level = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most)
    in_points = (points[:, letter] > level).astype(np.float32)
    of_q, of_p, wide = queries.sum(axis=1), points.sum(axis=1), max(1, (1 << 21) // max(len(letter), 1))
    q_out, p_out = [], []
    for i in range(0, len(queries), wide):
        common = (queries[i : i + wide][:, letter] > level).astype(np.float32) @ in_points.T
        q, p = np.nonzero((of_q[i : i + wide, None] - common <= 1) & (of_p[None, :] - common <= up))
        q_out.append(i + q)
        p_out.append(p)
    return np.concatenate(q_out), np.concatenate(p_out)


def within_boxes(points: np.ndarray, queries: np.ndarray, up: int, twig: int = TWIG) -> tuple[np.ndarray, np.ndarray]:
    """Query and point numbers within the distance, by a k-d tree whose boxes are those of its points."""
    q_out, p_out, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], queries.sum(axis=1)
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        mine = points[p]
        low, high = mine.min(axis=0), mine.max(axis=0)
        used = np.flatnonzero(high)
        asked = queries[np.ix_(q, used)]
        down = np.maximum(asked - high[used], 0).sum(axis=1) + sums[q] - asked.sum(axis=1)
        q = q[(down <= 1) & (np.maximum(low[used] - asked, 0).sum(axis=1) <= up)]
        if not len(q):
            continue
        split = balanced_split(mine) if len(p) > twig else None
        if split:
            left = mine[:, split[0]] <= split[1]
            stack += [(p[left], q), (p[~left], q)]
            continue
        for i in range(0, len(p), twig):
            a, b = steps(queries[q], mine[i : i + twig], up)
            q_out.append(q[a])
            p_out.append(p[i + b])
    return np.concatenate(q_out), np.concatenate(p_out)


def one_edit(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in one place, or those a letter longer become the others by losing one letter."""
    if long.shape[1] == short.shape[1]:
        return (long != short).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(long[:, :-1] == short, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= short.shape[1]


def _best(n: np.ndarray, words: np.ndarray, row: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row that has a near word, how many, and the best of them: largest n, then smallest word."""
    rank = np.zeros(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], row))
    rows, first, counts = np.unique(row[order], return_index=True, return_counts=True)
    return rows, counts, near[order][first]


def _near_of(group: pa.Table) -> pa.Table:
    """Near words between the points of a block, all of one length, and its queries. Words of the leaf itself ask, too (``asks`` 2)."""
    words = np.array(group.column("word").to_pylist(), object)
    n, asks = (group.column(c).to_numpy(zero_copy_only=False) for c in ("n", "asks"))
    code, bounds = letters(group.column("word"))
    counts, lengths = letter_counts(code, bounds), np.diff(bounds)
    points, one, two = np.flatnonzero(asks == 0), [], []
    length = lengths[points[0]] if len(points) else 0
    for mine, up in ((np.flatnonzero((asks > 0) & (lengths == length)), 1), (np.flatnonzero(lengths == length + 1), 0)):
        if not len(points) or not len(mine):
            continue
        q, p = within_boxes(counts[points], counts[mine], up)
        step = max(1, (1 << 22) // int(length))
        for i in range(0, len(q), step):
            a, b = mine[q[i : i + step]], points[p[i : i + step]]
            spelled = lambda rows: code[bounds[rows][:, None] + np.arange(lengths[rows[0]])]
            real = one_edit(spelled(a), spelled(b))
            a, b = a[real], b[real]
            once = (asks[a] == 1) | np.array(words[a] > words[b], bool)  # two words of one leaf both ask
            one.append(a[once])
            two.append(b[once])
    a, b = (np.concatenate([*x, *y, np.zeros(0, np.int64)]).astype(np.int64) for x, y in ((one, two), (two, one)))
    rows, many, best = _best(n, words, a, b)
    return pa.table({"word": pa.array(words[rows].tolist(), pa.string()), "many": pa.array(many, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array(words[best].tolist(), pa.string())})


# --- all words -----------------------------------------------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best (its near word of largest n, then smallest) of every word that has a near one."""
    by_length = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()  # one row a length
    sizes = {r.length: r.n for r in by_length}
    total = sum(sizes.values())
    if not total:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.col("word").alias("best")).where("false")
    sample = words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(max(1, total // SAMPLE + 1))) == 0).toPandas()["word"]
    code, bounds = letters(pa.array(sample, pa.string()))
    trees = upper_trees(letter_counts(code, bounds), np.diff(bounds), sizes, max(LEAF, -(-total // LEAVES)))
    routed = checkpointed(words.select("word", "n").mapInArrow(routes(trees), "word string, n long, leaf long, asks byte"))
    cut = routed.groupBy("leaf").agg(F.sum(1 - F.col("asks")).alias("points"), F.count("*").alias("asking"), F.greatest(F.lit(1), F.max(F.length("word")) / 64).alias("size"))
    parts = lambda rows, most: F.ceil(F.col(rows) * F.col("size") / most).cast("int")
    cut = cut.select("leaf", parts("points", POINTS).alias("p"), parts("asking", ASKING).alias("q")).where("p > 0")
    rows = routed.join(F.broadcast(cut), "leaf")  # at most LEAVES leaves and one a length
    some = lambda salt, of: F.pmod(F.xxhash64("word", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    points = rows.where("asks = 0").select("leaf", "word", "n", "asks", some(1, "p").alias("of_p"), F.explode(every("q")).alias("of_q"))
    mine = rows.where("asks = 0").select("leaf", "word", "n", F.lit(2).cast("byte").alias("asks"), F.explode(every("p")).alias("of_p"), some(2, "q").alias("of_q"))
    asking = rows.where("asks = 1").select("leaf", "word", "n", "asks", F.explode(every("p")).alias("of_p"), some(2, "q").alias("of_q"))
    blocks = points.unionByName(mine).unionByName(asking)
    found = blocks.groupBy("leaf", "of_p", "of_q").applyInArrow(_near_of, "word string, many long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("many").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, form`` -> ``word, root``: the last of the chain of forms. Each round doubles the steps; counts grow along a chain, so it ends."""
    links = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = checkpointed(links.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return links


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = checkpointed(word_counts(docs))
    near = words.join(near_words(words), "word", "left").withColumn("_has", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    near = checkpointed(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_has"), F.col("best")).alias("form"), F.when(F.col("_has"), F.col("best_n")).alias("form_n")))
    roots = roots_of(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
