"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

#: Pieces longer than this, in bytes, are merged one by one with a heap, which is exact too.
WIDEST = 256
#: Pieces whose ids a process remembers, before it starts anew.
REMEMBERED = 250_000
#: Bytes of text in one round of splitting.
CHUNK_BYTES = 1_500_000

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: white space, letter (L*), number (N*), other."""
    import regex

    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for pattern, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            if b - a == len(m.group()) - 1:
                out[a : b + 1] = value
            else:
                out[[ord(c) for c in m.group()]] = value
    return out


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all bytes, ends of pieces in them, pieces of each text) by the public pre-tokenizer pattern, vectorised.

    The pattern takes, in this order: an apostrophe with s, t, re, ve, m, ll or d; a run of letters, of numbers or of
    other signs, each with one space before it; white space not followed by more of something else; white space.
    """
    whole = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = whole.encode("utf-8", "surrogatepass")
    n = len(whole)
    if not n:
        return b"", np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    first = np.zeros(n + 1, bool)  # where a text begins
    edges = np.concatenate(([0], np.cumsum(lengths)))
    first[edges] = True
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # A space goes to what follows it in its text; another last sign of white space is a piece of its own.
    follows = np.zeros(n, bool)  # white space with something else after it
    follows[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]
    last = np.flatnonzero(follows)
    begins[last] = True
    begins[last[code[last] == 32] + 1] = False
    # Contractions: an apostrophe that is a run of its own without a space before it.
    at = np.flatnonzero((code == 39) & begins[:n])
    for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
        here = at[at + len(tail) < n]
        for i, c in enumerate(tail, 1):
            here = here[(code[here + i] == ord(c)) & ~first[here + i]]
        begins[here + 1] = False
        after = here + len(tail) + 1
        begins[after] = True
    starts = np.flatnonzero(begins)
    width = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
    offsets = np.concatenate(([0], np.cumsum(width)))
    places = offsets[starts]
    of_text = np.searchsorted(starts, edges)
    return data, places[1:], np.diff(of_text)


def merge_in_order(ids: list[int], pairs: dict[int, int], size: int) -> list[int]:
    """ids after all merges, one at a time: the pair of least rank, and of these the leftmost, comes next from a heap.

    ``pairs``: of left * size + right, the id they merge to; ids ascend with ranks.
    """
    ids, n = list(ids), len(ids)
    get = pairs.get
    heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] * size + ids[i + 1])) is not None]
    if not heap:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or get(ids[i] * size + ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (m := get(rank * size + ids[after[i]])) is not None:
                heapq.heappush(heap, (m, i))
        if (k := before[i]) >= 0 and (m := get(ids[k] * size + rank)) is not None:
            heapq.heappush(heap, (m, k))
    return [x for x in ids if x >= 0]


class Vocabulary:
    """Ranks of byte strings and a hash table of the pairs that merge.

    The table has open addressing with linear probing; a pair of ids merges to the id of its joined bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.full(256, -1, np.int64)
        for c in range(256):
            self.single[c] = ranks.get(bytes([c]), -1)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        mask = (1 << self.bits) - 1
        places = self._place(np.fromiter(pairs, np.int64, len(pairs))).tolist() if pairs else []
        self.probes = 1
        for (key, rank), place in zip(pairs.items(), places, strict=True):
            steps = 1
            while self.keys[place] >= 0:
                place, steps = (place + 1) & mask, steps + 1
            self.keys[place], self.values[place] = key, rank
            self.probes = max(self.probes, steps)
        self.token_length = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.token_start = np.concatenate(([0], np.cumsum(self.token_length)))[:-1]
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Start anew: no piece is remembered. A remembered piece has a number; its ids are a run of ``flat``."""
        self.memory: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair merges to; ``size`` where it doesn't merge."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        out = np.full(keys.shape, self.size, np.int64)
        flat, found = keys.ravel(), out.ravel()
        todo = np.flatnonzero(flat >= 0)
        place, mask = self._place(flat[todo]), (1 << self.bits) - 1
        for _ in range(self.probes):
            there = self.keys[place]
            hit = there == flat[todo]
            found[todo[hit]] = self.values[place[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            todo, place = todo[more], (place[more] + 1) & mask
        return found.reshape(keys.shape)

    def matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes: one padded row each, all rows merge one pair a round.

        Returns the order in which rows came to an end, their counts of ids, and the ids one row after the other.
        """
        rows = len(pieces)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        length = np.fromiter(map(len, pieces), np.int64, rows)
        ids = np.where(np.arange(width) < length[:, None], self.single[data], -1)
        order, counts, done = [], [], []
        index = np.arange(rows)
        ranks = self.merged(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((rows, 0), self.size)
        while len(index):
            least = ranks.min(axis=1) if ranks.shape[1] else np.full(len(index), self.size)
            live = least < self.size
            if not live.all():
                ended = ids[~live]
                order.append(index[~live])
                counts.append(length[~live])
                done.append(ended[ended >= 0])
                ids, ranks, length, index = ids[live], ranks[live], length[live], index[live]
                if not len(index):
                    break
            at = ranks.argmin(axis=1)  # the leftmost of the least
            r = np.arange(len(index))
            ids[r, at] = ranks[r, at]
            # Compaction: what lies right of the merged pair moves one to the left.
            wide = ids.shape[1]
            keep = np.ones(ids.shape, bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(len(index), wide - 1)
            keep = np.ones(ranks.shape, bool)
            keep[r, at] = False
            ranks = ranks[keep].reshape(len(index), wide - 2)
            length = length - 1
            if wide > 2:
                right = np.minimum(at, wide - 3)
                fits = at <= wide - 3
                renewed = self.merged(ids[r, right], ids[r, right + 1])
                ranks[r[fits], at[fits]] = renewed[fits]
                left = np.maximum(at - 1, 0)
                renewed = self.merged(ids[r, left], ids[r, left + 1])
                fits = at > 0
                ranks[r[fits], left[fits]] = renewed[fits]
        return tuple(np.concatenate(x) for x in (order, counts, done))

    def heaped(self, piece: bytes) -> np.ndarray:
        """Ids of a piece of any length: the same merges, one at a time."""
        return np.array(merge_in_order([self.ranks[bytes([c])] for c in piece], self.pairs, self.size), np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces not met before, by buckets of lengths."""
        buckets: dict[int, list[bytes]] = {}
        names, counts, runs = [], [], []
        for p in pieces:
            n = len(p)
            if (rank := self.ranks.get(p)) is not None:
                names.append(p)
                counts.append(1)
                runs.append(rank)
            elif n > WIDEST:
                names.append(p)
                ids = self.heaped(p)
                counts.append(len(ids))
                runs.extend(ids.tolist())
            else:
                buckets.setdefault(next(w for w in (4, 6, 8, 11, 16, 23, 32, 64, 128, WIDEST) if n <= w), []).append(p)
        all_counts, all_runs = [np.array(counts, np.int64)], [np.array(runs, np.int64)]
        for width, some in buckets.items():
            step = max(1, 400_000 // width)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                order, counted, ids = self.matrix(part, width)
                names += [part[i] for i in order.tolist()]
                all_counts.append(counted)
                all_runs.append(ids)
        counted = np.concatenate(all_counts)
        self.memory.update(zip(names, range(len(self.memory), len(self.memory) + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counted) - counted])
        self.lengths = np.concatenate([self.lengths, counted])
        self.flat = np.concatenate([self.flat, *all_runs])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.memory) > REMEMBERED:
            self.forget()
        data, ends, counts = split(texts)
        bounds = [0, *ends.tolist(), len(data)] if data else []
        pieces = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        memory = self.memory
        if fresh := [p for p in set(pieces) if p not in memory]:
            self.learn(fresh)
        numbers = np.fromiter(map(memory.__getitem__, pieces), np.int64, len(pieces))
        length = self.lengths[numbers]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[numbers] - (ends - length), length) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[np.cumsum(counts)]
        return np.split(ids, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the joined tokens."""
        length = self.token_length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ids) else 0
        source = np.repeat(self.token_start[ids] - (ends - length), length) + np.arange(total)
        return self.token_bytes[source].tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: A place at which no piece goes on, whatever stands around it: a space after an ASCII letter or figure.
_CUT = re.compile("(?<=[A-Za-z0-9]) ")


def _chunks(texts: list[str]):
    """Lists of (part of a text, whether the text goes on), of about CHUNK_BYTES or less, but for parts without a cut."""
    part, size = [], 0
    for t in texts:
        at = 0
        while True:
            cut = _CUT.search(t, at + CHUNK_BYTES) if len(t) - at > CHUNK_BYTES else None
            end = cut.start() if cut else len(t)
            part.append((t[at:end], cut is not None))
            size += end - at
            at = end
            if size >= CHUNK_BYTES:
                yield part
                part, size = [], 0
            if not cut:
                break
    if part:
        yield part


def encode_long(own: Vocabulary, texts: list[str]):
    """Ids of each text, of which a part is in work at a time."""
    open_ids: list[np.ndarray] = []
    for part in _chunks(texts):
        for ids, (_, goes_on) in zip(own.encode([t for t, _ in part]), part, strict=True):
            open_ids.append(ids)
            if not goes_on:
                yield np.concatenate(open_ids) if len(open_ids) > 1 else ids
                open_ids = []


def encode_texts(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``) of every row of docs (doc_id, text).

    ``path``: the file of ranks, installed at the same place on every executor; by default that of the installed
    public tokenizers package, looked up on the executor. Null counts as empty: no ids, digests of no bytes. Repeated
    rows are each encoded; an empty table gives an empty result.

    A narrow pass: no exchange. Memory is bounded by a few MB of text at a time, ``REMEMBERED`` pieces a process, and
    the ids of one text; a text without a space after a letter or figure is split in one go.
    """
    base = pick(docs, "doc_id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from .common import slices

        own = vocabulary(path or default_path())
        for batch in slices(batches, 1024):
            columns = [[], [], [], []]
            for ids in encode_long(own, batch.column("text").to_pylist()):
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                columns[2].append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    columns[3].append(ids.astype(np.int32))
            arrays = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(columns[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return base.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``decoded`` (binary) of rows with doc_id and ``ids`` (array of ints); null ids give no bytes."""
    base = pick(rows, "doc_id", "ids")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = vocabulary(path or default_path())
        for batch in batches:
            out = [own.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return base.mapInArrow(run, f"doc_id {kind}, decoded binary")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every document, and of what they decode to."""
    return encode_texts(table(spark, sf_dir, "documents"))
