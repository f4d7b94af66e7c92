"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how often which ids do.

Rows are shuffled by full text, so each distinct text is tokenised and aligned once; its links count as often as it
occurs. Its measures are stored in the shared folder under a 128-bit hash of the text, joined there to the corpus-wide
counts of the linked id pairs, and at last to the rows' doc_ids. A text that very many rows have is spread over tasks.

A text is encoded in chunks that no token of either vocabulary crosses: they begin at a space or newline between two
characters that are neither white space nor rare (``cuts``). Byte-level pieces end there by their pattern; the other
vocabulary is asked whether any of its pieces has a space after another character, or a newline. A worker learns each chunk
once, many at a time, and forgets rare ones beyond ``REMEMBERED``; what it remembers changes no result. A chunk whose joined
token bytes are not its own has its whole text encoded and compared again.

The pair counts are sent to all tasks while there are at most ``SENT`` of them (some tens of MB); beyond that both sides are
shuffled by pair, frequent pairs spread.

Null and empty texts, and those whose joined bytes differ from space and text, have zeros and ''; equal texts get equal
measures whatever their doc_id, null included; an empty table gives no rows; other columns are ignored. Sums beyond a long
raise an error.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.common import checkpointed, new_folder, slices
from strideflow.llm.near_dup import spread_join

SENT, REMEMBERED, TOGETHER = 1_000_000, 600_000, 1 << 17
#: First bytes of characters that may stand beside a cut. Those left out begin white space, marks of white space or rare characters.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]] = True


def byte_level_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies show bytes."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


# --- the two vocabularies ---------------------------------------------------------------------------


@dataclass
class Vocabularies:
    """Encoders of both, each id's bytes, and whether texts may be cut at spaces and newlines."""

    encode_a: Callable[[str], list[int]]
    encode_b: Callable[[str], list[int]]
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    at: bytes
    lengths_a: np.ndarray = field(init=False)
    lengths_b: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Vocabularies:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        shown, names = byte_level_bytes(), a.get_vocab(with_added_tokens=True)
        of_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            of_a[i] = bytes(shown[c] for c in name) if all(c in shown for c in name) else name.encode()
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        spec = json.loads(a.to_str())
        apart = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]
        apart = apart and not any("▁" in p.lstrip("▁") for p in pieces)
        newline = apart and not any("\n" in p for p in pieces)
        return cls(lambda t: a.encode(t, add_special_tokens=False).ids, b.encode, of_a, of_b, (b" \n" if newline else b" ") if apart else b"")

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by both vocabularies of bytes that begin with a space or newline; None if their bytes differ from it."""
        text = raw.decode("utf-8", "surrogatepass")
        a, b = self.encode_a(text), self.encode_b(text[1:] if raw[:1] == b" " else text)
        if raw[:1] != b" ":
            if not b or self.bytes_b[b[0]] != b" ":
                return None
            b = b[1:]  # the space that this vocabulary puts before every text
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def cuts(data: np.ndarray, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the given white space between two plain characters, where chunks begin; which bytes belong to plain characters."""
    lead = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
    plain = PLAIN[data[lead]]
    space = np.zeros(256, bool)
    space[list(at)] = True
    return np.flatnonzero(space[data[1:-1]] & plain[:-2] & plain[2:]) + 1, plain


@dataclass
class Aligned:
    """Chunks end to end: numbers of ids of both kinds and of groups, each chunk's groups as text, its links as numbers a * width + b."""

    n_a: np.ndarray
    n_b: np.ndarray
    texts: list[bytes]
    links: np.ndarray
    bounds: np.ndarray


def align(vocabularies: Vocabularies, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> Aligned:
    """Groups of the ids of some chunks that end at these bytes."""
    end_a, end_b = np.cumsum(vocabularies.lengths_a[a]), np.cumsum(vocabularies.lengths_b[b])
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    stop_a, stop_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
    name_a, name_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups = [",".join(name_a[p:q]) + "|" + ",".join(name_b[r:s]) for p, q, r, s in zip([0, *stop_a[:-1].tolist()], stop_a.tolist(), [0, *stop_b[:-1].tolist()], stop_b.tolist(), strict=True)]
    bounds = np.concatenate([[0], np.searchsorted(both, ends) + 1])
    texts = [";".join(groups[p:q]).encode() for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    count = lambda end: np.diff(np.concatenate([[0], np.searchsorted(end, ends) + 1]))
    return Aligned(count(end_a), count(end_b), texts, a[stop_a - 1] * len(vocabularies.bytes_b) + b[stop_b - 1], bounds)


class Learner:
    """Aligns texts by their chunks, each learned once."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.known: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.numbers, self.links, self.bounds, self.uses = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the chunks that were used more than once since the last time, if they are few enough."""
        keep = np.flatnonzero(self.uses > 1)
        keep = keep if len(keep) <= REMEMBERED // 2 else keep[:0]
        place = np.full(len(self.uses) + 1, -1)
        place[keep] = np.arange(len(keep))
        self.known = {c: k for c, n in self.known.items() if (k := int(place[n])) >= 0}
        self.texts = [self.texts[k] for k in keep.tolist()]
        self.links, lengths = self.links_of(keep)
        self.numbers, self.bounds, self.uses = self.numbers[keep], np.concatenate([[0], np.cumsum(lengths)]), np.zeros(len(keep), np.int64)

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of these chunks end to end, and how many each has."""
        size = self.bounds[numbers + 1] - self.bounds[numbers]
        skip = np.repeat(self.bounds[numbers] - (np.cumsum(size) - size), size)
        return self.links[np.arange(len(skip)) + skip], size

    def _keep(self, chunks: list[bytes], found: Aligned) -> None:
        self.known.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks)), strict=True))
        self.texts += found.texts
        self._new.append((np.stack([found.n_a, found.n_b], 1), found.links, found.bounds[1:]))

    def _learn_alone(self, chunk: bytes) -> None:
        ids = self.v.encode(chunk)
        if ids is None:
            self.known[chunk] = -1
        else:
            self._keep([chunk], align(self.v, *ids, np.array([len(chunk)])))

    def learn(self, chunks: dict[bytes, bool]) -> None:
        """Chunks that may stand between others are encoded many at a time; the others, and those of a bad piece, alone."""
        self._new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        together, size = [], 0
        for chunk, regular in [*chunks.items(), (None, False)]:
            if chunk is None or size > TOGETHER:
                ids = self.v.encode(b"".join(together)) if together else None
                if ids is not None:
                    self._keep(together, align(self.v, *ids, np.cumsum([len(c) for c in together])))
                else:
                    for c in together:
                        self._learn_alone(c)
                together, size = [], 0
            if chunk is None:
                continue
            if regular:
                together.append(chunk)
                size += len(chunk)
            else:
                self._learn_alone(chunk)
        if self._new:
            self.numbers = np.concatenate([self.numbers, *[x for x, _, _ in self._new]])
            shift = len(self.links) + np.concatenate([[0], np.cumsum([len(x) for _, x, _ in self._new])])
            self.links = np.concatenate([self.links, *[x for _, x, _ in self._new]])
            self.bounds = np.concatenate([self.bounds, *[x + s for (_, _, x), s in zip(self._new, shift, strict=False)]])
            self.uses = np.concatenate([self.uses, np.zeros(len(self.texts) - len(self.uses), np.int64)])

    def measures(self, texts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        """n_a, n_b, the groups as text and the links of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        full = b"".join(b" " + t for t in texts)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        inner, plain = cuts(np.frombuffer(full, np.uint8), self.v.at)
        places = np.union1d(inner, begins)
        chunks = [full[p:q] for p, q in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
        regular = plain[np.minimum(places[:-1] + 1, len(full) - 1)] & plain[places[1:] - 1] & bool(self.v.at)
        new = {c: r for c, r in zip(chunks, regular.tolist(), strict=True) if c not in self.known}
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.uses += np.bincount(number[number >= 0], minlength=len(self.uses))
        rows = np.searchsorted(places, begins)
        for text, p, q in zip(texts, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            mine = number[p:q]
            if not text:
                yield 0, 0, b"", np.zeros(0, np.int64)
            elif mine.min() < 0:
                ids = self.v.encode(b" " + text)
                if ids is None:
                    yield 0, 0, b"", np.zeros(0, np.int64)
                else:
                    whole = align(self.v, *ids, np.array([len(text) + 1]))
                    yield int(whole.n_a[0]), int(whole.n_b[0]), whole.texts[0], whole.links
            else:
                n_a, n_b = self.numbers[mine].sum(axis=0).tolist()
                yield n_a, n_b, b";".join(map(self.texts.__getitem__, mine.tolist())), self.links_of(mine)[0]


def aligner(path_a: str, path_b: str):
    """A function of batches of distinct texts and their numbers of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for batch in slices(batches, "text"):
            learner = learner or Learner(Vocabularies.load(path_a, path_b))
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            n_a, n_b, n_groups, digest, pairs, times = [], [], [], [], [], []
            for a, b, groups, links in learner.measures(texts):
                pair, count = np.unique(links, return_counts=True)
                n_a.append(a)
                n_b.append(b)
                n_groups.append(len(links))
                digest.append(hashlib.sha256(groups).hexdigest() if groups else "")
                pairs.append(pair)
                times.append(count)
            places = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times).astype(np.int32))], ["pair", "times"])
            kept = [batch.column(c) for c in ("first", "second", "n")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], pa.array(digest, pa.string()), pa.ListArray.from_arrays(places, flat)],
                                             ["first", "second", "n", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


# --- the corpus -----------------------------------------------------------------------------------------


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """pair, total (links corpus-wide), best (whether its B id has no more frequent pair), n (distinct texts that have it)."""
    counts = links.groupBy("pair").agg(F.sum(F.col("times") * F.col("n")).alias("total"), F.count("*").alias("n"))
    of_b = Window.partitionBy(F.pmod("pair", F.lit(width)))  # at most as many rows as A has ids
    return checkpointed(counts.withColumn("best", F.col("total") == F.max("total").over(of_b)))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark, key = docs.sparkSession, ["first", "second"]
    text = F.coalesce(docs["text"], F.lit(""))
    hashed = [F.xxhash64("text").alias("first"), F.xxhash64(F.lit(1), "text").alias("second")]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("_spread"))
    distinct = rows.groupBy("text").agg(F.count("*").alias("n")).select(*hashed, "n", "text")
    folder = new_folder(spark, "alignment")
    schema = "first long, second long, n long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair: long, times: int>>"
    distinct.mapInArrow(aligner(path_a, path_b), schema).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)

    links = stored.select(*key, "n", F.inline("links"))
    width = len(Vocabularies.load(path_a, path_b).bytes_b)
    counts = pair_counts(links, width)
    few = counts.count() <= SENT
    links = links.drop("n")
    known = links.join(F.broadcast(counts.drop("n")), "pair") if few else spread_join(links, counts, ["pair"], counts.agg(F.sum("n")).first()[0], "first")
    sums = known.groupBy(*key).agg(F.sum(F.col("times") * F.col("total")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    measures = ["n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256"]
    final = checkpointed(stored.drop("links").join(sums, key, "left").select(*key, "n", *measures))
    total = final.agg(F.sum("n")).first()[0] or 0
    out = spread_join(rows.select("doc_id", *hashed, "_spread"), final, key, total, "_spread")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
