"""Token ids in binary shards with a minimal perfect hash index.

A shard holds raw little-endian ids, document after document, then its keys and an index, then a fixed footer. The
index sends each of n keys to one of n entries: level by level, keys that hash to a bit of their own settle there and
the others try the next level; the number of set bits before a key's bit is its entry (Limasset et al., 2017). An
entry holds the key's fingerprint, offset and count, so a lookup reads a few bits and one entry, and a foreign key is
refused by its fingerprint.

Documents are range-partitioned by doc_id, so shards follow one another in ascending order; tasks write files under
names of their own in the shared folder and return them, so lost or repeated attempts leave nothing but unused files.

Null texts are empty documents (the end id alone); null doc_ids come first and get keys like others; rows with equal
doc_id are kept, in order of their text's checksum, under keys numbered by occurrence; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.common import LOWER, SPACES, buffer_of, checkpointed, mix, new_folder, open_new, open_old, slices, word_hashes, words_of

END, MAGIC, FOOTER = 2, b"SFTOKEN1", struct.Struct("<QQQQQQ8s")
NULL_KEY = -(1 << 63)
#: The pieces into which this tokenizer family splits a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How byte-level models show bytes: those with a visible Latin-1 character as it, the others by characters from 256 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
LATIN_END = "\u0250"


# --- the index -------------------------------------------------------------------------------


def hashes(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(nth.astype(np.uint64) + np.uint64(1)))


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h + np.uint64((level + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit hashes to 0..n-1, without gaps."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, total = levels, [], 0
        for bits in levels:
            self.before.append(total + np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1))]))
            total += int(bits.sum())
        self.n = total

    @classmethod
    def build(cls, h: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels = []
        while len(h):
            size = -(-int(gamma * len(h) + 64) // 64) * 64
            place = _place(h, len(levels), size).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            h = h[~alone[place]]
            if len(levels) > 64:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 for keys that settle nowhere."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, bits in enumerate(self.levels):
            place = _place(h[open_], k, len(bits)).astype(np.int64)
            hit = bits[place]
            p = place[hit]
            words = bits.reshape(-1, 64)[p >> 6]
            out[open_[hit]] = self.before[k][p >> 6] + (words & (np.arange(64) < (p & 63)[:, None])).sum(1)
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        packed = [struct.pack("<Q", len(b)) + np.packbits(b, bitorder="little").tobytes() for b in self.levels]
        return struct.pack("<Q", len(packed)) + b"".join(packed)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<Q", raw), 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", raw, at)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at + 8), bitorder="little").astype(bool))
            at += 8 + size // 8
        return cls(levels)


ENTRY = np.dtype([("fingerprint", "<u4"), ("count", "<u8"), ("offset", "<u8")])


class ShardWriter:
    """Payload first, as it comes; keys, index and footer on close."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.keys, self.counts = stream, width, [], []

    def add(self, keys: list[int], ids: np.ndarray, counts: list[int]) -> None:
        """Documents with these keys and numbers of ids; their ids end to end."""
        self.stream.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys += keys
        self.counts += counts

    def close(self) -> tuple[int, int]:
        keys, counts = np.array(self.keys, np.int64), np.array(self.counts, np.uint64)
        nth = occurrences(keys)
        h = hashes(keys, nth)
        table = PerfectHash.build(h)
        entries = np.zeros(len(keys), ENTRY)
        at = table.find(h)
        entries["fingerprint"][at], entries["count"][at] = fingerprint(h), counts
        entries["offset"][at] = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint64) if len(counts) else 0
        index = table.to_bytes()
        total = int(counts.sum())
        parts = [keys.astype("<i8").tobytes(), index, entries.tobytes()]
        for part in parts:
            self.stream.write(part)
        self.stream.write(FOOTER.pack(self.width, total, len(keys), len(parts[0]), len(parts[1]), len(parts[2]), MAGIC))
        self.stream.close()
        return len(keys), total


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key stood before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.searchsorted(ranked, ranked)
    return out


class Shard:
    """Keyed access to a shard's documents; only index and keys are kept in memory."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.width, self.tokens, n, keys, index, entries, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or self.tokens * self.width + keys + index + entries + FOOTER.size != size:
            raise ValueError("not a whole shard")
        at = self.tokens * self.width
        self.keys = np.frombuffer(file.read_at(keys, at), "<i8")
        self.table = PerfectHash.from_bytes(file.read_at(index, at + keys))
        self.entries = np.frombuffer(file.read_at(entries, at + keys + index), ENTRY)
        if not n == len(self.keys) == len(self.entries) == self.table.n:
            raise ValueError("index and keys differ")

    def locate(self, keys: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset and count of each key, and whether the shard has it."""
        h = hashes(keys, nth)
        at = self.table.find(h)
        known = at >= 0
        found = self.entries[np.maximum(at, 0)] if len(self.entries) else np.zeros(len(h), ENTRY)
        known &= found["fingerprint"] == fingerprint(h)
        return found["offset"].astype(np.int64), found["count"].astype(np.int64), known

    def ids(self, offset: int, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(count * self.width, offset * self.width), f"<u{self.width}")


# --- encoding --------------------------------------------------------------------------------


class Encoder:
    """Encodes with a public tokenizer, word by word from a bounded cache, a whole Arrow batch at a time.

    The tokenizer drops white space and never joins pieces across it, so a text's ids are its words' ids end to end.
    A batch's words are found by their hashes; length, first and last eight bytes (and all bytes of longer words) are
    compared too, so equal hashes of different words do no harm: such batches are encoded text by text. Unknown words of
    Latin letters, and such with one mark behind, go to the tokenizer's model at once; other words that begin with a letter are
    encoded together, and told apart by their word-end tokens; the rest one by one. Long texts are cut at white space,
    so memory is bounded by ``CHUNK`` and ``most_words``, not by a text.
    """

    CHUNK, RECENT = 1 << 20, 1 << 17

    def __init__(self, path: str, most_words: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if max([*vocab.values(), END]) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces = regex.compile(PIECES)
        self.whole = self.ends.any() and [e.ids for e in self._batch(["Ab c", "ab"])] == [self._one("ab") + self._one("c"), self._one("ab")]
        tried = ("the", "qzxkvvw", "\u00e9t\u00e9", "\u00e8\u0159\u01b6")
        self.marks = {m: self._direct(chr(m)) for m in b".,;:!?"}
        self.direct = all(self._direct(w) == self._one(w) and all(self._one(w + chr(m)) == self._direct(w) + ids for m, ids in self.marks.items()) for w in tried)
        self._forget()

    def _forget(self) -> None:
        """An empty cache. Slots are found in sorted hashes, or among recent ones; each has the bounds of its ids in ``pool``."""
        self.known, self.slot_of, self.recent = np.zeros(0, np.uint64), np.zeros(0, np.int32), {}
        self.long: dict[int, bytes] = {}
        self.size, self.begin, self.count, self.shape = 0, np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros((1024, 3), np.uint64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _direct(self, word: str) -> list[int]:
        """The ids of one piece: Latin letters, or a mark. Such letters are in normal form C as they stand."""
        shown = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(SHOWN)
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by the tokenizer."""
        out: list[list[int]] = [[]] * len(words)
        many: dict[int, int] = {}
        alone = []
        for k, w in enumerate(words):
            text = w.decode("utf-8").lower()  # may part a letter from its mark
            behind = self.marks.get(w[-1])
            core = text if behind is None else text[:-1]
            if self.direct and core.isalpha() and max(core) < LATIN_END:
                out[k] = self._direct(core) + (behind or [])
            elif "<|" not in text and (n := len(self.pieces.findall(text))):
                many[k] = n
            else:
                alone.append(k)
        joint = list(many)
        for a in range(0, len(joint), 4096):
            part = joint[a : a + 4096]
            ids = self._batch([" ".join(words[k].decode("utf-8") for k in part)])[0].ids
            stops = np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1
            counts = np.cumsum([many[k] for k in part])
            if len(stops) != counts[-1]:  # these can't be told apart
                alone += part
                continue
            cut = stops[counts - 1].tolist()
            for k, x, y in zip(part, [0, *cut], cut, strict=False):
                out[k] = ids[x:y]
        for k in alone:
            out[k] = self._one(words[k].decode("utf-8"))
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes], shapes: np.ndarray) -> np.ndarray:
        """The new words' slots."""
        found, base = self._ids(words), self.size
        sizes = np.array([len(x) for x in found], np.int32)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        self.size = total = base + len(words)
        if total > len(self.begin):
            self.begin, self.count, self.shape = (np.concatenate([x, np.zeros((total + len(x), *x.shape[1:]), x.dtype)]) for x in (self.begin, self.count, self.shape))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(flat), np.uint32)])
        self.begin[base:total] = self.used + np.cumsum(sizes) - sizes
        self.count[base:total], self.shape[base:total] = sizes, shapes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        slots = np.arange(base, total)
        self.long |= {base + k: w for k, w in enumerate(words) if len(w) > 16}
        self.recent |= dict(zip(hashes.tolist(), slots.tolist(), strict=True))
        if len(self.recent) > self.RECENT:
            known = np.concatenate([self.known, np.fromiter(self.recent, np.uint64, len(self.recent))])
            slot_of = np.concatenate([self.slot_of, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
            order = np.argsort(known, kind="stable")
            self.known, self.slot_of, self.recent = known[order], slot_of[order], {}
        return slots

    def _slots_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Each word's slot, new words learned; None where two different words have one hash."""
        names, first, of = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]), 8)
        size = ends - starts
        shape = np.stack([np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0] for at in (starts + 8, ends)] + [size.astype(np.uint64)], axis=1)
        under = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
        some = under < 64
        shape[some, 0] &= (np.uint64(1) << under[some]) - np.uint64(1)
        shape[some, 1] >>= np.uint64(64) - under[some]
        slots = np.full(len(names), -1, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, names), len(self.known) - 1)
            hit = self.known[at] == names
            slots[hit] = self.slot_of[at[hit]]
        rest = np.flatnonzero(slots < 0)
        slots[rest] = np.fromiter((self.recent.get(k, -1) for k in names[rest].tolist()), np.int64, len(rest))
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = first[new]
            slots[new] = self._learn(names[new], [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], shape[at])
        slots = slots[of]
        if not np.array_equal(shape, self.shape[slots]):
            return None
        for k in np.flatnonzero(size > 16).tolist():
            if data[starts[k] : ends[k]].tobytes() != self.long[int(slots[k])]:
                return None
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, without end ids, and each text's number of ids. Null texts have none."""
        if not self.whole:
            return self._plain(texts)
        data, bounds = buffer_of(texts)
        data = LOWER[data]  # A-Z only; the tokenizer lower-cases the rest
        counts, parts, at = np.zeros(len(bounds) - 1, np.int64), [], 0
        while at < len(data):
            stop = min(at + self.CHUNK, len(data))
            while stop < len(data):  # back, else on, to white space
                breaks = np.flatnonzero(SPACES[data[at + 1 : stop]])
                if len(breaks):
                    stop = at + 1 + int(breaks[-1])
                    break
                stop = min(stop + self.CHUNK, len(data))
            if self.size > self.most:
                self._forget()
            own = data[at:stop]
            starts, ends, rows = words_of(own, np.clip(bounds - at, 0, len(own)), SPACES)
            at = stop
            if not len(starts):
                continue
            slots = self._slots_of(own, starts, ends)
            if slots is None:
                return self._plain(texts)
            size = self.count[slots].astype(np.int64)
            ahead = np.concatenate([[0], np.cumsum(size)])
            parts.append(self.pool[np.repeat(self.begin[slots] - ahead[:-1], size) + np.arange(ahead[-1])])
            counts += np.diff(ahead[rows])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), counts

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self._one(t or ""), np.uint32) for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)


# --- Spark -----------------------------------------------------------------------------------


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """This Python worker's encoder; tasks that follow one another in a worker share its cache."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write all documents in ascending doc_id order; shard, path, n_docs, n_tokens of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, uri = encoder_for(tokenizer), None, ""
        for batch in slices(batches, "text"):
            if writer is None:
                uri, stream = open_new(folder, ".ids")
                writer = ShardWriter(stream, encoder.width)
            ids, counts = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            writer.add([NULL_KEY if k is None else k for k in batch.column("doc_id").to_pylist()], ids, (counts + 1).tolist())
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    check = F.crc32(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], check.alias("check"))
    rows = rows.repartitionByRange("doc_id", "check").sortWithinPartitions("doc_id", "check")
    return checkpointed(rows.select("doc_id", "text").mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, looked up by key in its shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with open_old(path) as file:
                    shard = Shard(file)
                    nth = occurrences(shard.keys)
                    for a in range(0, len(shard.keys), 2048):
                        keys = shard.keys[a : a + 2048]
                        offset, count, known = shard.locate(keys, nth[a : a + 2048])
                        if not known.all():
                            raise ValueError(f"{path}: a stored key is not in the index")
                        sums = [zlib.crc32(shard.ids(o, c).astype("<u4").tobytes()) for o, c in zip(offset.tolist(), count.tolist(), strict=True)]
                        ids = pa.array(keys, pa.int64(), mask=keys == NULL_KEY)
                        yield pa.RecordBatch.from_arrays([ids, pa.array(base + offset), pa.array(count), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    rows = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = max(1, shards.count())
    return rows.select("path", "base").repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer, new_folder(docs.sparkSession, "token-ids")))
