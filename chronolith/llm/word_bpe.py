"""BPE with word ends: unsplit text is encoded by halves, and joined where windows around the cut agree.

A piece of text that the pre-tokenizer leaves whole is encoded as a tree. Leaves are merged by themselves; where two
sides meet, the last ids of the left and the first of the right are encoded anew together, in windows of 1, 2, 4, ...
ids, until the first id of the window is again the one the left side had there and the last one that of the right. A
row of ids is the encoding of its text exactly if every two neighbours are (merges go in order of rank, so nothing else
decides whether a pair across a border ever merges); so with both ends of a window agreed, the whole is right.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import merge_in_order
from .common import materialize, pick, slices, table

#: Symbols that are merged as they are; longer runs are encoded by halves.
LEAF = 12
#: Characters of a text beyond which its halves are rows of their own, encoded by different tasks.
BLOCK_CHARS = 32_768
#: Pieces whose ids a process remembers, before it starts anew.
REMEMBERED = 400_000

#: Scripts in which all Unicode versions in use agree on composition and case; other texts take the library's own normalizer.
_RARE = re.compile("[^\u0000-֏Ḁ-῿ -⯿　-꓏가-힣！-￯\U0001f300-\U0001f5ff]")


@lru_cache(1)
def _classes() -> dict[str, str]:
    r"""Ranges, as inside of brackets, of ``\p{L}``, ``\p{N}`` and ``\s`` as the tokenizers library takes them.

    Those beyond the first plane have keys of their own: a bracket with any of them is no table look-up but a search.
    """
    from tokenizers import Regex, pre_tokenizers

    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True)
        spans: list[list[int]] = []
        for start in range(0, sys.maxunicode + 1, 4096):
            codes = [c for c in range(start, min(start + 4096, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
            for _, (a, b) in runs.pre_tokenize_str("".join(map(chr, codes))) if codes else ():
                if spans and spans[-1][1] + 1 == codes[a]:
                    spans[-1][1] = codes[b - 1]
                else:
                    spans.append([codes[a], codes[b - 1]])
        for plane, least, most in (("", 0, 0xFFFF), ("beyond", 0x10000, sys.maxunicode)):
            out[name + plane] = "".join(f"\\U{max(a, least):08x}-\\U{min(b, most):08x}" for a, b in spans if a <= most and b >= least)
    return out


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    further = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(further)) for b in range(256)]


class WordVocabulary:
    """Merges and pieces of a vocabulary file (JSON of the tokenizers library, BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in (vocab | self.special).items()}
        self.size = max(self.token_of) + 1
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.pairs: dict[int, int] = {}
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.last)}
        newest = max(self.symbols)
        for a, b in model["merges"]:
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            if out <= newest or left not in self.symbols or right not in self.symbols:
                raise ValueError(f"merge {a!r} {b!r}: ids must ascend with ranks, and parts be merged before")
            self.pairs[left * self.size + right] = newest = out
            self.symbols[out] = self.symbols[left] + self.symbols[right]
        self.normalizer = Tokenizer.from_file(path).normalizer
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        classes = _classes()
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            pattern = pattern.replace(name, classes[name])
        self.pattern = re.compile(pattern)
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.stand_in = tuple((re.compile(f"[{classes[name + 'beyond']}]"), sign) for name, sign in ((r"\p{L}", "x"), (r"\p{N}", "1")))
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.memory = {token: (str(i), token) for token, i in self.special.items()}

    def normalized(self, text: str) -> str:
        """Composed and in lower case, letter by letter; white space stays, as it only parts pieces."""
        if text.isascii():
            return text.lower()
        if _RARE.search(text):
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # else a last sigma would be special

    def split(self, text: str) -> list[str]:
        """Pieces of a normalised text. Signs beyond the first plane are looked at as an x, 1 or ! in their place."""
        if text.isascii() or not self.beyond.search(text):
            return self.pattern.findall(text)
        plain = text
        for signs, sign in self.stand_in:
            plain = signs.sub(sign, plain)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.beyond.sub("!", plain))]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text in order; special tokens are found before anything is normalised."""
        if not self.marks or not self.marks.search(text):
            return self.split(self.normalized(text))
        out = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.split(self.normalized(part))
        return out

    def tree(self, symbols: list[int]) -> list[int]:
        """Ids of a run of symbols: its halves, joined."""
        if len(symbols) <= LEAF:
            return merge_in_order(symbols, self.pairs, self.size)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the text of both sides, each of which is the encoding of its own part."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = merge_in_order([s for i in (*a, *b) for s in self.symbols[i]], self.pairs, self.size)
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return left[: max(0, len(left) - k)] + window + right[k:]
            k *= 2

    def encode_part(self, part: str, ends: bool) -> list[int]:
        """Ids of a piece, or of a part of one; ``ends``: whether the piece ends with it."""
        if part in self.special:
            return [self.special[part]]
        data = part.encode("utf-8", "surrogatepass")
        symbols = [self.inner[c] for c in data]
        if ends and data:
            symbols[-1] = self.last[data[-1]]
        return self.tree(symbols)

    def learn(self, pieces: set[str]) -> None:
        token_of = self.token_of
        for p in pieces:
            ids = self.encode_part(p, True)
            self.memory[p] = (" ".join(map(str, ids)), " ".join([token_of[i] for i in ids]))

    def encode_text(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by one space, and the text they decode to: tokens joined by one space."""
        pieces = self.pieces(text)
        if len(self.memory) > REMEMBERED:
            self.forget()
        self.learn({p for p in pieces if p not in self.memory})
        found = list(map(self.memory.__getitem__, pieces))
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def halves(self, text: str, most: int):
        """(pieces or parts of pieces, whether the first goes on from before, whether the last goes on) of each of 2, 4, 8, ...
        even parts of a text's pieces, of about ``most`` characters. Cuts fall where they fall, within pieces too."""
        pieces = self.pieces(text)
        size = sum(map(len, pieces))
        parts = 1
        while size > parts * most:
            parts *= 2
        own: list[str] = []
        at, cut, opened = 0, 1, False
        for p in pieces:
            begin = 0
            while cut < parts and at + len(p) - begin > (border := cut * size // parts):
                inside = 0 if p in self.special else border - at
                if inside > 0:
                    own.append(p[begin : begin + inside])
                    at, begin = at + inside, begin + inside
                goes_on = begin > 0
                yield own, opened, goes_on
                own, opened, cut = [], goes_on, cut + 1
            own.append(p[begin:])
            at += len(p) - begin
        yield own, opened, False

    def encode_parts(self, own: list[str], opened: bool, goes_on: bool) -> tuple[list[int], int, int]:
        """Ids of a part, and how many of them belong to a first piece from before and to a last one that goes on."""
        ids: list[int] = []
        head = tail = 0
        for i, p in enumerate(own):
            open_end = goes_on and i == len(own) - 1
            got = self.encode_part(p, not open_end)
            head = len(got) if opened and i == 0 else head
            tail = len(got) if open_end else tail
            ids += got
        return ids, head, tail

    def join_parts(self, a: tuple[list[int], int, int], b: tuple[list[int], int, int]) -> tuple[list[int], int, int]:
        """Two neighbouring parts as one; a piece that both hold a part of is joined."""
        (left, a_head, a_tail), (right, b_head, b_tail) = a, b
        if not a_tail or not b_head:  # the cut lies between pieces, or a side is empty
            return left + right, a_head or (0 if left else b_head), b_tail or (0 if right else a_tail)
        both = self.join(left[-a_tail:], right[:b_head])
        head = len(both) if a_head == a_tail == len(left) else a_head
        tail = len(both) if b_head == b_tail == len(right) else b_tail
        return left[:-a_tail] + both + right[b_head:], head, tail

    def join_all(self, parts: list[tuple[list[int], int, int]]) -> list[int]:
        """Ids of a text from its parts: neighbours are joined two by two."""
        while len(parts) > 1:
            parts = [self.join_parts(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][0] if parts else []

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token_of[i] for i in ids])


@lru_cache(2)
def word_vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _row(ids: str, decoded: str, with_ids: bool) -> tuple:
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return (ids.count(" ") + 1 if ids else 0, digest(ids), digest(decoded), *([list(map(int, ids.split()))] if with_ids else []))


def encode_words(docs: DataFrame, path: str | None = None, with_ids: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``) of every row of docs (doc_id, text).

    ``path``: the vocabulary file, installed at the same place on every executor; by default that of the installed public
    tokenizers package, looked up there. Special tokens in a text count as such, none are added. Null counts as empty:
    no ids, digests of no bytes. Repeated rows are each encoded, whatever their doc_id; an empty table gives an empty result.

    Texts of at most ``block_chars`` characters take a narrow pass. Longer ones are split once, cut into halves of halves
    (which are written, so that every later reader sees the same ones), encoded by whichever task gets a part, and joined.
    A text is one value where it is split, and its ids are one value where they are joined; no more is gathered.
    """
    base = pick(docs, "doc_id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kind = base.schema["doc_id"].dataType.simpleString()
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def made(doc_ids, rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], ["doc_id", *fields])

    def whole(batches):
        own = word_vocabulary(path or default_path())
        for batch in slices(batches):
            yield made(batch.column("doc_id"), [_row(*own.encode_text(t), with_ids) for t in batch.column("text").to_pylist()])

    def cut(batches):
        own = word_vocabulary(path or default_path())
        for batch in slices(batches, 16):
            for i, (tag, text) in enumerate(zip(batch.column("tag").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                parts = list(own.halves(text, block_chars))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tag] * len(parts), pa.int64()), pa.concat_arrays([batch.column("doc_id").slice(i, 1)] * len(parts)), pa.array(range(len(parts)), pa.int32()),
                        pa.array([" ".join(p[0]) for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.bool_()), pa.array([p[2] for p in parts], pa.bool_()),
                    ],
                    ["tag", "doc_id", "part", "pieces", "opened", "goes_on"],
                )

    def encoded(batches):
        own = word_vocabulary(path or default_path())
        for batch in slices(batches, 16):
            rows = [own.encode_parts(p.split(" ") if p else [], o, g) for p, o, g in zip(*(batch.column(c).to_pylist() for c in ("pieces", "opened", "goes_on")), strict=True)]
            arrays = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("tag"), batch.column("doc_id"), batch.column("part"), *arrays], ["tag", "doc_id", "part", "ids", "head", "tail"])

    def joined(group):
        own = word_vocabulary(path or default_path())
        group = group.sort_by("part")
        ids = own.join_all(list(zip(*(group.column(c).to_pylist() for c in ("ids", "head", "tail")), strict=True)))
        row = _row(" ".join(map(str, ids)), own.decode(ids), with_ids)
        return pa.Table.from_batches([made(group.column("doc_id").combine_chunks().slice(0, 1), [row])])

    long = base.filter(F.length("text") > block_chars).select(F.monotonically_increasing_id().alias("tag"), "doc_id", "text")
    parts = materialize(long.mapInArrow(cut, f"tag bigint, doc_id {kind}, part int, pieces string, opened boolean, goes_on boolean"), "halves")
    done = parts.repartition("tag", "part").mapInArrow(encoded, f"tag bigint, doc_id {kind}, part int, ids array<int>, head int, tail int")
    short = base.filter(F.length("text") <= block_chars).mapInArrow(whole, schema)
    return short.unionByName(done.groupBy("tag").applyInArrow(joined, schema))


def decode_words(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``decoded`` of rows with doc_id and ``ids`` (array of ints): tokens joined by one space; null ids give ''."""
    base = pick(rows, "doc_id", "ids")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = word_vocabulary(path or default_path())
        for batch in slices(batches):
            out = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return base.mapInArrow(run, f"doc_id {kind}, decoded string")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every document, and of what they decode to."""
    return encode_words(table(spark, sf_dir, "documents"))
