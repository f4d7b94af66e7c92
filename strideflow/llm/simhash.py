"""Near-duplicate documents by 64-bit SimHash, compared bit-sliced.

A fingerprint is the majority of the bits of the XXH64 (seed 42) of all four-word shingles of the lower-cased text,
repeats included. Equal fingerprints are folded first, so copies cost nothing. Two fingerprints within a radius of four
bits agree on at least one of five disjoint parts of any bits chosen: fingerprints branch to one node per part and value,
and a node that stays large branches again on five parts of the bits that it doesn't fix yet. The pigeonhole makes this
exact at every size; the width of the parts follows the number of fingerprints, so nodes stay near ``NODE``.

Within a node fingerprints lie vertically, as 64 bit planes. A query's bits are added to all its neighbours' distances at
once, 64 to a word, by carry-save counters of three bits; words whose 64 distances all exceed the radius are abandoned
after a few planes. Nodes over ``BLOCK`` are cut into blocks, and each pair of blocks is one bounded task: nothing is capped.
A task returns a spanning forest of its links, not all of them.

A null, empty or wordless text has fingerprint zero, linked like any other; fewer than four words are one shingle;
repeated rows and two texts under one doc_id are rows like others; a row without doc_id links others and gets the smallest
doc_id that it reaches, null where its group has none; an empty table gives no rows; other columns are ignored. Texts are
read in pieces, so memory doesn't grow with them by more than the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import LOWER, checkpointed, slices
from strideflow.llm.near_dup import connected_components, spread_join

RADIUS, SHINGLE, SEED = 4, 4, 42
NODE, BLOCK, LEVELS, PIECE = 2048, 4096, 2, 1 << 20
_SPACES = b" \t\n\v\f\r"


# --- fingerprints ------------------------------------------------------------------------------


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; each piece begins with the last SHINGLE - 1 words of the one before."""
    start, carried = 0, []
    while start < len(raw):
        end = start + PIECE
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        words = carried + raw[start:end].split()
        yield words
        start, carried = end, words[max(0, len(words) - SHINGLE + 1) :]


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each full shingle."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    bounds = zip(begins[:n].tolist(), (begins[SHINGLE:] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in bounds), np.uint64, n)


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as an unsigned number."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER.tobytes())
    total, n, words = np.zeros(64, np.int64), 0, []
    for words in _pieces(raw):
        hashes = _shingle_hashes(words)
        total, n = total + _bits_set(hashes), n + len(hashes)
    if not n:
        if not words:
            return 0
        n, total = 1, _bits_set(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    return int((np.uint64(1) << np.flatnonzero(2 * total > n).astype(np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in slices(batches, "text"):
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        spread = np.arange(done, done + batch.num_rows)
        done += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints), pa.array(spread)], ["doc_id", "print", "spread"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint's 64 bits as a long), spread (a number to salt by)."""
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(_fingerprints, "doc_id long, print long, spread long")


# --- bit-sliced comparison -----------------------------------------------------------------------


def planes_of(prints: np.ndarray) -> np.ndarray:
    """64 bit planes; plane i holds bit i of all fingerprints, 64 to a word. Places past the last one repeat it."""
    padded = np.concatenate([prints, np.repeat(prints[-1:], -len(prints) % 64)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view("<u8")


def _add(counters: list[np.ndarray], over: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Add two bits to every counter: one full adder, then carries; what leaves the highest counter stays in ``over``."""
    half = counters[0] ^ one
    carry = (counters[0] & one) | (half & two)
    np.bitwise_xor(half, two, out=counters[0])
    for c in counters[1:]:
        carry, c[...] = c & carry, c ^ carry
    over |= carry


def _at_most(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the places whose counter is at most the radius."""
    less, equal = np.zeros_like(over), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            less |= equal & ~counters[k]
            equal &= counters[k]
        else:
            equal &= ~counters[k]
    return less | equal


def within(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS, checks: tuple[int, ...] = (20, 28, 40)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, word numbers and bits of the places within the radius; words without one are left out.

    All words go through the first planes; at each check, words whose 64 distances all exceed the radius are abandoned.
    """
    masks = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    shape = (len(queries), planes.shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64)
    for i in range(0, checks[0], 2):
        _add(counters, over, planes[i] ^ masks[:, i, None], planes[i + 1] ^ masks[:, i + 1, None])
    query, word = np.nonzero(_at_most(counters, over, radius))
    counters, over = [c[query, word] for c in counters], over[query, word]
    for start, stop in zip(checks, (*checks[1:], 64), strict=True):
        for i in range(start, stop, 2):
            _add(counters, over, planes[i][word] ^ masks[query, i], planes[i + 1][word] ^ masks[query, i + 1])
        keep = _at_most(counters, over, radius) != 0
        query, word, counters, over = query[keep], word[keep], [c[keep] for c in counters], over[keep]
    return query, word, _at_most(counters, over, radius)


def forest(prints: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the places ``one`` and ``two`` of distinct fingerprints."""
    label, a, b = np.arange(len(prints)), [], []
    planes = planes_of(prints[two])
    for start in range(0, len(one), 256):
        part = one[start : start + 256]
        query, word, bits = within(prints[part], planes)
        rows, places = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        place = word[rows] * 64 + places
        real = place < len(two)
        query, place = query[rows][real], two[place[real]]
        cuts = np.flatnonzero(np.diff(query)) + 1
        for group in np.split(np.arange(len(query)), cuts) if len(query) else []:
            q = part[query[group[0]]]
            roots, first = np.unique(label[place[group]], return_index=True)
            other = roots != label[q]
            if other.any():
                a += [int(prints[q])] * int(other.sum())
                b += prints[place[group][first[other]]].tolist()
                label[np.isin(label, roots)] = label[q]
    return a, b


def _links_of(group: pa.Table) -> pa.Table:
    """Links between the two sides of a pair of blocks; within a block both sides are the same."""
    prints, side = (group.column(c).to_numpy(zero_copy_only=False) for c in ("print", "side"))
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a, b = forest(prints.view(np.uint64), one, two)
    return pa.table({"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))})


# --- nodes -----------------------------------------------------------------------------------------


def _parts(free: list[int], width: int) -> list[list[int]]:
    """RADIUS + 1 disjoint parts of the free bits, of that width at most."""
    most = len(free) // (RADIUS + 1)
    return [free[k * most : k * most + min(width, most)] for k in range(RADIUS + 1)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << i for i in bits)
    return value - (1 << 64) if value >> 63 else value


def _width(rows: int) -> int:
    return max(1, int(np.ceil(np.log2(max(rows, 1) / NODE)))) if rows > NODE else 0


def _branch(rows: DataFrame, of: list[int], free: list[int], width: int) -> tuple[DataFrame, list[tuple[list[int], list[int]]]]:
    """One row per part of the free bits: ``node`` changes with the part and its bits, ``path`` numbers the parts taken."""
    parts = _parts(free, width)
    child = lambda k: F.struct(F.lit(of + [k]).cast("array<int>").alias("path"), F.xxhash64("node", F.lit(k), F.col("print").bitwiseAND(F.lit(_mask(parts[k])))).alias("node"))
    out = rows.select("print", F.explode(F.array(*map(child, range(len(parts))))).alias("x")).select("print", "x.path", "x.node")
    return out, [(of + [k], [i for i in free if i not in parts[k]]) for k in range(len(parts))]


def links(prints: DataFrame, total: int) -> DataFrame:
    """``a, b``: links that join all of ``print`` (distinct) within the radius, found exactly."""
    rows = prints.select("print", F.array().cast("array<int>").alias("path"), F.lit(0).cast("long").alias("node"))
    free, found, most = [([], list(range(64)))], [], total
    for level in range(LEVELS + 1):
        if most <= BLOCK or level == LEVELS:
            found.append(rows.select("print", "node"))
            break
        width, branched, kinds = _width(most), [], []
        for of, bits in free:
            mine = rows.where(F.col("path") == F.lit(of).cast("array<int>")) if of else rows
            out, more = _branch(mine, of, bits, width)
            branched.append(out)
            kinds += more
        rows = branched[0]
        for out in branched[1:]:
            rows = rows.unionByName(out)
        sizes = checkpointed(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= BLOCK or level + 1 == LEVELS:
            found.append(rows.select("print", "node"))
            break
        rows = checkpointed(spread_join(rows, sizes, ["node"], total * (RADIUS + 1) ** (level + 1), "print"))
        found.append(rows.where(F.col("n") <= BLOCK).select("print", "node"))
        rows, free = rows.where(F.col("n") > BLOCK).drop("n"), kinds
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _block_links(out, total)


def _block_links(rows: DataFrame, total: int) -> DataFrame:
    """Links within nodes; those over BLOCK are cut into blocks, and each pair of blocks is a task of its own."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    rows = spread_join(rows, sizes, ["node"], total, "print").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("print", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("print", "node", own.alias("own"), other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("print", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"))
    return rows.groupBy("node", "low", "high").applyInArrow(_links_of, "a long, b long")


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = checkpointed(fingerprints(docs))
    known = checkpointed(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    counts = known.agg(F.count("*"), F.sum("n")).first()
    parts = connected_components(links(known.select("print"), counts[0]))
    final = known.join(parts.withColumnRenamed("id", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = final.groupBy("component").agg(F.min("least").alias("component_id"))
    final = checkpointed(final.select("print", "n", "component").join(least, "component").select("print", "n", "component_id"))
    out = spread_join(rows, final, ["print"], counts[1] or 0, "spread")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
