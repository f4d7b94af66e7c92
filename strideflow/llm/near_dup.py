"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Equal sets are folded into one class first, told apart by two
hashes of the set, so copies cost nothing. Each class has 128 minwise tokens. A tree branches classes by a chosen minwise
token; a node with few classes is compared exhaustively, a larger one branches again by the tree's next token, so unlike
documents that share a passage part, and independent trees are repeated until the recall target holds.

Large nodes of true copies never get small. They aren't compared pair by pair: each class is first compared with its
node's first one, links that hold are joined to components, and later rounds only compare classes of different
components. No link between components is lost by that, and nothing is capped: at the last level, large nodes are cut
into blocks, and what lies outside a node's largest component is compared with the rest on full sets, block by block: first
in one of EARLY nodes, then in those of the others that are still of different components.
Rows of a node, or of a class, that holds more than 1/HEAVY of all rows are spread over SALTS tasks when they are joined
to what is known of their group.

Pairs whose minwise tokens agree too little (five standard deviations under the threshold) are dropped; the others are
confirmed on full shingle sets, ``100 * intersection >= 75 * union``.

Null or wordless texts have an empty set and link with nothing; a text of fewer than five words is one shingle; repeated
rows fall into one class, two texts under one doc_id into the classes of their texts; a row without doc_id links others and
gets the smallest doc_id that it reaches (kept only where its group has none: component null), and ``one_of_each`` treats it like the rest; an empty table gives no rows; other columns
are ignored, and kept by ``one_of_each``.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import LOWER, SPACES, buffer_of, mix, planned_once, settled, shingles, slices, tidied, word_hashes, words_of

SIGNATURE, DEPTH, STAR_TREES, SMALL_NODE, BLOCK, FEWEST_EQUAL = 128, 4, 5, 16, 512, 72
BROADCAST_IDS, HEAVY, SALTS, EARLY, ROWS_A_TASK, WIDE = 250_000, 4096, 64, 8, 131_072, 16
_MULTIPLIERS = (mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def trees_for(recall: float = 0.99999, similarity: float = 0.75, depth: int = DEPTH) -> int:
    """Independent trees that find a pair with this probability when it must survive ``depth`` branchings."""
    trees = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**depth)))
    if trees * depth > SIGNATURE:
        raise ValueError(f"{trees} independent trees take {trees * depth} minwise tokens; there are {SIGNATURE}")
    return trees


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, bounds = buffer_of(batch.column("text"))
    data = LOWER[data]
    starts, ends, rows = words_of(data, bounds, SPACES)
    hashes = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        yield shingles(hashes[a:b])


def _lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), values)


def _class_key(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; -1 as the second for the empty one."""
    if not len(s):
        return 0, -1
    return int(np.add.reduce(mix(s))) - (1 << 63), int(np.bitwise_xor.reduce(mix(s + np.uint64(77)))) >> 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        counts, keys, tokens = [], [], []
        for s in _sets(batch):
            counts.append(len(s))
            keys.append(_class_key(s))
            if not len(s):
                continue
            short = (s >> np.uint64(32)).astype(np.uint32)
            least = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
            for i in range(0, len(short), 2048):
                np.minimum(least, (short[i : i + 2048, None] * _MULTIPLIERS).min(axis=0), out=least)
            tokens.append(least)
        flat = np.concatenate(tokens).view(np.int32) if tokens else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("check"), pa.array(counts, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
             _lists(flat, [SIGNATURE * (n > 0) for n in counts])],
            ["doc_id", "check", "n_shingles", "first", "second", "tokens"],
        )


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()  # a task gives each set once
    for batch in slices(batches, "text"):
        found = {}
        for s in _sets(batch):
            key = _class_key(s)
            if key not in seen:
                seen.add(key)
                found[key] = s
        flat = np.concatenate(list(found.values())).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), _lists(flat, [len(s) for s in found.values()])], ["first", "second", "shingles"])


def features(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("check"))
    return rows.mapInArrow(_features, "doc_id long, check long, n_shingles long, first long, second long, tokens array<int>")


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, salt: str) -> DataFrame:
    """Rows joined to their groups, of which ``n`` tells the size; a group of more than 1/HEAVY of all rows is spread by ``salt``.

    There are fewer than HEAVY such groups, whatever the table: their keys are sent to all tasks.
    """
    heavy = F.col("n") > total / HEAVY
    hot = groups.where(heavy).select(*keys, F.lit(SALTS).alias("_salts"))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    salts = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(groups.withColumn("_salt", F.explode(salts)), [*keys, "_salt"]).drop("_salt")


def sized(df: DataFrame, rows: int, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """A table of about ``rows`` rows in the tasks that it needs: one for ``rows_a_task`` of them, and one for each core.

    Adaptive execution does the same where it may; otherwise a small table is cut into very many small blocks at each exchange,
    and the driver keeps a record of each task.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_a_task)))


def laid(df: DataFrame, wide: bool = False) -> tuple[DataFrame, int]:
    """``settled``, in the tasks that its rows need (``wide``: rows of some KB), and the number of its rows."""
    out = settled(df)
    with planned_once(df.sparkSession):
        n = sized(out, 0).count()
    return sized(out, n, ROWS_A_TASK // WIDE if wide else ROWS_A_TASK), n


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b`` -> ``id, component`` (the smallest id reachable) by alternating large-star and small-star steps.

    Every step aggregates minima before the shuffle and joins them back, so a hub costs no large group; the table
    is checkpointed after each round and only its row count and checksum reach the driver. Few edges need no adaptive
    execution: a hub has at most 8 tasks' rows then.
    """
    edges, n = laid(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    fit = lambda df: sized(df, 2 * n)  # noqa: E731  # no step makes more rows than two for each edge
    while True:
        edges = fit(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = fit(fit(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = fit(large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v"))
        with planned_once(links.sparkSession) if 2 * n <= 8 * ROWS_A_TASK else contextlib.nullcontext():
            edges = settled(fit(small.distinct()))
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tidied(links.sparkSession)
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def _with_sides(pairs: DataFrame, count: int, side: Callable[[str], DataFrame]) -> DataFrame:
    """Checkpointed pairs, ``count`` of them, joined to both their classes. One class may be the first of very many pairs, so these are spread."""
    firsts = pairs.groupBy("a").agg(F.count("*").alias("n")).join(side("a"), "a")
    return spread_join(pairs, firsts, ["a"], count, "b").drop("n").join(side("b"), "b")


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose minwise tokens agree often enough to be worth a full comparison.

    The tokens' low bytes are compared, a quarter of the data: equal tokens have equal ones, so no pair is lost by that.
    """
    low = F.transform("tokens", lambda t: (F.pmod(t, F.lit(256)) - 128).cast("tinyint"))
    side = lambda s: classes.select(F.col("class").alias(s), F.col("n_shingles").alias(f"n_{s}"), low.alias(f"tokens_{s}"))
    both = _with_sides(*laid(pairs), side)
    same = F.size(F.filter(F.zip_with("tokens_a", "tokens_b", lambda x, y: x == y), lambda x: x))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * 75
    return both.where(sizes & (same >= FEWEST_EQUAL)).select("a", "b").distinct()


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles of the classes named. Only texts of their representatives (by doc_id and the text's check) are read into sets."""
    tidied(docs.sparkSession)
    wanted, n = laid(classes.join(wanted, "class", "left_semi").select("class", "first", "second", F.col("doc_id").alias("_id"), F.col("check").alias("_check")))
    few = n <= BROADCAST_IDS  # some tens of MB as a hash relation; beyond that both sides are shuffled
    sent = F.broadcast if few else lambda x: x
    rows = docs.select(docs["doc_id"], docs["text"])
    texts = rows.join(sent(wanted.select("_id", "_check")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_check")), "left_semi")
    sets = texts.mapInArrow(_full, "first long, second long, shingles array<long>")
    return laid(sets.join(sent(wanted.select("class", "first", "second")), ["first", "second"]).select("class", "shingles"), wide=True)[0]


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, similarity_percent: int = 75) -> DataFrame:
    """Pairs that hold on full sets. Only texts in some pair are read into sets."""
    pairs, count = laid(pairs)
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = _sets_of(docs, classes, wanted)
    side = lambda s: sets.select(F.col("class").alias(s), F.col("shingles").alias(f"s_{s}"))
    both = _with_sides(pairs, count, side)
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(common * 100 >= (F.size("s_a") + F.size("s_b") - common) * similarity_percent).select("a", "b").distinct()


def _paths(classes: DataFrame, trees: int) -> DataFrame:
    """One row per tree, in the tree's child that its first minwise token chooses."""
    root = lambda t: F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t).cast("long"), F.col("tokens")[t * DEPTH]).alias("node"))
    return classes.select("class", *(["component"] if "component" in classes.columns else []), F.explode(F.array(*map(root, range(trees)))).alias("x")).select("*", "x.tree", "x.node").drop("x")


def _branch(rows: DataFrame, classes: DataFrame, level: int, trees: int) -> DataFrame:
    """The child of a row's node that its tree's next minwise token chooses; only rows that branch again look their level's tokens up."""
    rows = rows.join(classes.select("class", F.array(*[F.col("tokens")[t * DEPTH + level] for t in range(trees)]).alias("_next")), "class")
    return rows.withColumn("node", F.xxhash64("node", F.get("_next", F.col("tree")))).drop("_next")


def _stars(rows: DataFrame, total: int) -> DataFrame:
    """Each class with the first one of its node."""
    nodes = rows.groupBy("node").agg(F.min("class").alias("a"), F.count("*").alias("n")).where("n > 1")
    return sized(spread_join(rows.select("node", "class"), nodes, ["node"], total, "class"), total).where("class <> a").select("a", F.col("class").alias("b")).distinct()


def _links_within(group: pa.Table) -> pa.Table:
    """Links on full sets between the ``minor`` rows of a bounded block and its other rows, of different components; a spanning forest suffices."""
    ids, part, minor = (group.column(c).to_numpy(zero_copy_only=False) for c in ("class", "component", "minor"))
    lists = group.column("shingles").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    kept, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    names, of = np.unique(part, return_inverse=True)
    one, two = np.flatnonzero(minor), np.flatnonzero(~minor)
    common = np.zeros((len(one), len(two)), np.float32)
    for start in range(0, len(kept), 4096):
        here = (column >= start) & (column < start + 4096)
        m = np.zeros((len(ids), min(4096, len(kept) - start)), np.float32)
        m[row[here], column[here] - start] = 1
        common += m[one] @ m[two].T
    holds = (100 * common >= 75 * (sizes[one][:, None] + sizes[two][None, :] - common)) & (of[one][:, None] != of[two][None, :])
    root = np.arange(len(names))
    links = []
    for x, y in zip(*np.nonzero(holds), strict=True):
        p, q = of[one[x]], of[two[y]]
        while root[p] != p:
            p = root[p]
        while root[q] != q:
            q = root[q]
        if p != q:
            root[p] = q
            links.append((min(ids[one[x]], ids[two[y]]), max(ids[one[x]], ids[two[y]])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _dense_links(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Confirmed links inside large leaves, between what lies outside a leaf's largest component (``minor``) and all the leaf.

    Both are cut into blocks of about BLOCK classes; each pair of blocks is one bounded group. What the largest component
    holds is settled, so its classes are repeated once for each block of the others only.
    """
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    leaves = parts.groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("_major"), F.max_by("component", F.struct("n", "component")).alias("major"))
    leaves = leaves.select("node", "n", "major", F.ceil(F.col("n") / BLOCK).cast("int").alias("_all"), F.ceil((F.col("n") - F.col("_major")) / BLOCK).cast("int").alias("_minor"))
    total = rows.count()
    rows = sized(spread_join(rows.select("node", "class", "component"), leaves, ["node"], total, "class"), total)
    in_all, in_minor = F.pmod(F.xxhash64("class"), F.col("_all")).cast("int"), F.pmod(F.xxhash64("class", F.lit(1)), F.col("_minor")).cast("int")
    sides = [
        rows.select("node", "class", "component", F.lit(False).alias("minor"), in_all.alias("all"), F.explode(F.sequence(F.lit(0), F.col("_minor") - 1)).alias("of")),
        rows.where("component <> major").select("node", "class", "component", F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("all"), in_minor.alias("of")),
    ]
    both, _ = laid(sides[0].unionByName(sides[1]))
    tidied(docs.sparkSession)
    both = both.join(_sets_of(docs, classes, both.select("class").distinct()), "class")
    return both.groupBy("node", "all", "of").applyInArrow(_links_within, "a long, b long")


def _rest(classes: DataFrame, trees: int, total: int) -> tuple[DataFrame, DataFrame | None]:
    """What the trees leave in one node but in different components: pairs from small leaves, rows of large ones (None: there are none)."""
    rows, pairs = _paths(classes, trees), []
    for level in range(1, DEPTH + 1):
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        rows, _ = laid(sized(spread_join(rows, nodes.select("node", "n"), ["node"], total, "class"), total))
        tidied(classes.sparkSession)
        leaves = rows.where(F.col("n") <= SMALL_NODE)
        a = leaves.select("node", F.col("class").alias("a"), F.col("component").alias("of_a"))
        b = leaves.select("node", F.col("class").alias("b"), F.col("component").alias("of_b"))
        pairs.append(a.join(b, "node").where("a < b and of_a <> of_b").select("a", "b"))
        rows = rows.where(F.col("n") > SMALL_NODE)
        if rows.isEmpty():
            rows = None
            break
        rows = rows.drop("n") if level == DEPTH else sized(_branch(rows.drop("n"), classes, level, trees), total)
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.distinct(), rows


def _still_apart(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of leaves with their components as they are known now, without the leaves that have become one."""
    rows = rows.select("node", "class").join(parts.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = rows.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("node")
    return rows.join(open_, "node", "left_semi")


def groups(docs: DataFrame, recall: float = 0.99999) -> DataFrame:
    """doc_id, check (a hash of the text), n_shingles, group (null for empty sets), least (the group's smallest doc_id) of every row."""
    trees = trees_for(recall)
    rows, total = laid(features(docs), wide=True)
    full = rows.where("n_shingles > 0")
    known = full.groupBy("first", "second").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "check")).alias("r"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    known, _ = laid(known.select("first", "second", "n", "least", "r.doc_id", "r.check").withColumn("class", F.monotonically_increasing_id()))
    keys = ["first", "second"]  # each class once, by its representative's row: copies of it have other ids, so no key is hot
    named_by = known.select("class", *[F.col(c).alias(f"_{c}") for c in (*keys, "doc_id", "check")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "doc_id", "check")]
    own = full.join(named_by, same[0] & same[1] & same[2] & same[3]).dropDuplicates(["class"])
    classes, count = laid(own.select("class", "first", "second", "doc_id", "check", "n_shingles", "tokens"), wide=True)

    stars = _stars(_paths(classes, STAR_TREES), count * STAR_TREES)
    links, _ = laid(_confirmed(docs, classes, _alike(stars, classes)))
    parts = connected_components(links)
    named = lambda part: classes.join(part.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    pairs, leaves = _rest(named(parts), trees, count * trees)
    more = _confirmed(docs, classes, _alike(pairs, classes))
    early = F.pmod(F.xxhash64("node"), F.lit(EARLY)) == 0  # most of what large leaves hold is in many of them: a few of them settle it
    more, _ = laid(more if leaves is None else more.unionByName(_dense_links(docs, classes, leaves.where(early))))
    join = lambda parts, links: parts if links.isEmpty() else connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))
    parts = join(parts, more)
    if leaves is not None:
        rest, n = laid(_still_apart(leaves.where(~early), parts))
        if n:
            parts = join(parts, laid(_dense_links(docs, classes, rest))[0])

    final = known.join(parts.withColumnRenamed("id", "class"), "class", "left").withColumn("group", F.coalesce("component", "class"))
    least = final.groupBy("group").agg(F.min("least").alias("least"))
    final = final.select("first", "second", "n", "group").join(least, "group")
    out = sized(spread_join(full.select("doc_id", "check", "n_shingles", "first", "second"), laid(final)[0], keys, total, "doc_id"), total)
    none = rows.where("n_shingles = 0").select("doc_id", "check", "n_shingles", F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("least"))
    return out.select("doc_id", "check", "n_shingles", "group", "least").unionByName(none)


def near_duplicates(docs: DataFrame, recall: float = 0.99999) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    out = groups(docs, recall).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, recall: float = 0.99999) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest doc_id (rows without one come last).

    Rows of equal doc_id and text are one document, also without words; of a doc_id that stands in two groups each may stay.
    What goes is decided on ids and checks of texts; texts move only where more than BROADCAST_IDS rows go.
    """
    rows, total = laid(groups(docs, recall).select("doc_id", "check", "group"))
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "check")
    linked = rows.where("group is not null")
    best = linked.groupBy("group").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    gone = spread_join(linked, best, ["group"], total, "doc_id").where(order != F.col("best"))
    gone = laid(gone.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check")).distinct())
    again = laid(rows.groupBy(F.col("doc_id").alias("_id"), F.col("check").alias("_check")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    packed = docs.select(docs["doc_id"].alias("_of"), F.xxhash64(docs["text"]).alias("_text_check"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))

    def joined(left: DataFrame, right: DataFrame, count: int, how: str) -> DataFrame:
        few = count <= BROADCAST_IDS  # some MB as a hash relation; beyond that both sides are shuffled
        return left.join(F.broadcast(right) if few else right, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text_check") == F.col("_check")), how)

    kept = joined(packed, *gone, "left_anti")
    if again[1]:
        kept = joined(kept, *again, "left_anti").unionByName(joined(kept, *again, "left_semi").dropDuplicates(["_of", "_text_check"]))
    return kept.select("_row.*")
