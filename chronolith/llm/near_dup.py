"""Near-duplicate classes: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges."""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, set_aside, slices, table
from .graph import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Hubs of each bucket in a round, chosen by an order of the bucket's own; from the second round on also the member with
#: most links. These rounds end when one finds no link between texts that weren't joined yet, or after ROUNDS.
HUBS, ROUNDS = 2, 2
#: Members outside a bucket's largest component that still meet its members pair by pair; of more, tiles are compared.
FEW = 4
#: A chunk of a tile has about so many shingles, and as many documents as if each had PER_ROW more.
CHUNK_SHINGLES, PER_ROW = 200_000, 200
#: Shingles of fewer documents of a tile than this are counted pair by pair, others by a matrix product.
OFTEN = 32

_P = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: bytes | None) -> bytes:
    """A-Z lower-cased, words [^\\x20\\x09-\\x0D]+ joined by single spaces."""
    return b" ".join(text.lower().split()) if text else b""


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a normal text, of which a part of whole words is in work at a time."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = text.find(b" ", at + _CHUNK // 2)
        end = len(text) if end < 0 else end
        parts.append(_hashed(text[at:end]))
        at = end + 1
    return np.concatenate(parts)


def _hashed(text: bytes) -> np.ndarray:
    """Of each word: polynomial over its bytes, mixed with its length."""
    size = max(_CHUNK, 1 << (len(text)).bit_length())
    up, down = _powers(size)
    data = np.frombuffer(text, np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words of a normal text; of all words, if they are fewer."""
    words = word_hashes(text)
    width = min(width, len(words))
    if not width:
        return words
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ words[i : len(words) - width + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(mix(out))


@lru_cache(1)
def _walk(bins: int) -> np.ndarray:
    """For each bin, the bins that it looks into while it is empty, in a random but fixed order."""
    return np.random.default_rng(2017).integers(0, bins, (bins, 1024))


def sketch(hashes: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation sketch of sorted hashes: the least of each bin; an empty bin copies that of a random full one."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.searchsorted(at, np.arange(bins, dtype=np.uint64))
    full = np.zeros(bins, bool)
    full[at.astype(np.int64)] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        walk = _walk(bins)[empty]
        seen = full[walk]
        source = walk[np.arange(len(empty)), seen.argmax(axis=1)]
        lost = ~seen.any(axis=1)
        if lost.any():  # no full bin on the whole walk: the next full one
            there = np.flatnonzero(full)
            source[lost] = there[np.searchsorted(there, empty[lost]) % len(there)]
        first[empty] = first[source]
    return hashes[first]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A bucket key for each band of the sketch."""
    bands = sketch(hashes).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bands[:, i])
    return out.view(np.int64)


def _sketched(batches):
    for batch in slices(batches):
        digests, counts, keys, texts = [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            text = normal(text)
            hashes = shingle_set(text)
            counts.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(text) if text else None)
            keys.append(band_keys(hashes) if text else None)
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("same"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(texts, pa.binary())],
            ["doc_id", "same", "n_shingles", "digest", "bands", "normal"],
        )


def _like(percent: int):
    """Keep the pairs whose whole sets of shingles are alike enough."""

    def run(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: bytes) -> np.ndarray:
            if node not in known:
                known[node] = shingle_set(text)
                if len(known) > 64:
                    known.popitem(last=False)
            return known[node]

        for batch in slices(batches):
            left, right = [], []
            columns = [batch.column(c) for c in ("a", "b", "text_a", "text_b")]
            a_s, b_s = columns[0].to_pylist(), columns[1].to_pylist()
            texts = [c.to_pylist() for c in columns[2:]]
            for a, b, text_a, text_b in zip(a_s, b_s, *texts, strict=True):
                x, y = of(a, text_a), of(b, text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _stars(members: DataFrame, labels: DataFrame | None, links: DataFrame | None, tested: DataFrame | None, number: int, percent: int) -> DataFrame:
    """Pairs a < b to compare in a round: each member of a bucket with the bucket's hubs that aren't joined to it yet."""
    # Exclusive or with a mask of the bucket orders the members anew in each bucket; the least is the hub.
    orders = [F.col("node").bitwiseXOR(F.xxhash64("key", F.lit(number * HUBS + k))) for k in range(HUBS)]
    if labels is None:
        members = members.withColumn("label", F.col("node"))
    else:
        both = links.select(F.col("a").alias("m")).union(links.select(F.col("b").alias("m")))
        degrees = both.groupBy("m").agg(F.count(F.lit(1)).alias("degree"))
        known = labels.join(degrees, labels.node == degrees.m).select(F.col("node").alias("m"), "label", "degree")
        members = members.join(known, members.node == known.m, "left").select("node", "n", "key", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
        # Fewest first: less the degree in the high bits, and an order of the bucket's own below.
        low = F.xxhash64("key", "node").bitwiseAND(F.lit((1 << 40) - 1))
        orders.append(F.shiftleft(-F.least(F.col("degree"), F.lit(1 << 20)).cast("long"), 40) + low)
        members = materialize(members, "labelled")
    picks = [c for k, o in enumerate(orders) for c in (F.min_by("node", o).alias(f"a{k}"), F.min_by("n", o).alias(f"n{k}"), F.min_by("label", o).alias(f"l{k}"))]
    hubs = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), *picks).where("low <> high")
    stars = F.array(*[F.struct(F.col(f"a{k}").alias("a"), F.col(f"n{k}").alias("na"), F.col(f"l{k}").alias("la")) for k in range(len(orders))])
    hubs = materialize(hubs.select(F.col("key").alias("bucket"), stars.alias("stars")), "hubs")
    met = members.join(hubs, members.key == hubs.bucket).select("node", "n", "label", F.explode("stars").alias("star"))
    alike = F.least("n", "star.na") * 100 >= F.greatest("n", "star.na") * percent
    met = met.where(alike & (F.col("label") != F.col("star.la")))
    edges = met.select(F.least("node", "star.a").alias("a"), F.greatest("node", "star.a").alias("b")).distinct()
    return edges if tested is None else edges.join(tested, ["a", "b"], "left_anti")


def _unjoined(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets whose members aren't all joined, with the bucket's largest part, the number of ``others``
    and the number of chunks that its members are dealt over."""
    known = labels.select(F.col("node").alias("m"), "label")
    members = members.join(known, members.node == known.m, "left").select("node", "n", "key", F.coalesce("label", "node").alias("label"))
    members = materialize(members, "labelled")
    parts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n") + PER_ROW).alias("weight"))
    buckets = parts.groupBy(F.col("key").alias("bucket")).agg(
        F.max_by("label", F.struct("size", "label")).alias("main"),
        (F.sum("size") - F.max("size")).alias("others"),
        F.ceil(F.sum("weight") / CHUNK_SHINGLES).cast("int").alias("chunks"),
    )
    buckets = buckets.where("others > 0")
    left = members.join(buckets, members.key == buckets.bucket).select("node", "n", "key", "label", "main", "others", "chunks")
    return materialize(left, "left")


def _meetings(left: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b to compare: each member outside the largest part with all members of its bucket."""
    few = left.where(F.col("others") <= FEW)
    hubs = few.where("label <> main").select(F.col("key").alias("bucket"), F.col("node").alias("hub_node"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))
    met = few.join(hubs, few.key == hubs.bucket)
    alike = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    met = met.where(alike & (F.col("label") != F.col("hub_label")))
    edges = met.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
    return edges.join(tested, ["a", "b"], "left_anti")


def _sets(batches):
    for batch in slices(batches):
        hashes = [shingle_set(text).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(hashes, pa.list_(pa.int64()))], ["node", "hashes"])


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each two of some sets: a square matrix, of which what lies above the diagonal counts.

    An element of few sets adds to each pair of them; the others, few in number, are columns of a matrix of ones.
    """
    d = len(sets)
    rows = np.repeat(np.arange(d), [len(x) for x in sets])
    items = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.lexsort((rows, items))
    rows, items = rows[order], items[order]
    count = np.bincount(items)
    some = np.flatnonzero((count[items] > 1) & (count[items] < OFTEN))
    few_rows, few_items = rows[some], items[some]
    out = np.zeros(d * d, np.float32)
    for k in range(1, OFTEN - 1):
        same = np.flatnonzero(few_items[k:] == few_items[:-k])
        if not len(same):
            break
        out += np.bincount(few_rows[same] * d + few_rows[same + k], minlength=d * d)
    out = out.reshape(d, d)
    often = np.flatnonzero(count >= OFTEN)
    step = max(1, (1 << 22) // max(1, d))
    for at in range(0, len(often), step):
        cut = often[at : at + step]
        there = np.flatnonzero((items >= cut[0]) & (items <= cut[-1]) & (count[items] >= OFTEN))
        ones = np.zeros((d, len(cut)), np.float32)
        ones[rows[there], np.searchsorted(cut, items[there])] = 1
        out += ones @ ones.T
    return out


def _tile(percent: int):
    """Joins (node, least node of its part of the tile) that the links of a tile make."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        node, label, chunk = (part.column(c).to_numpy() for c in ("node", "label", "chunk"))
        sets = [np.asarray(x, np.int64) for x in part.column("hashes").to_numpy(zero_copy_only=False)]
        n = np.array([len(x) for x in sets], np.float64)
        both = common_shingles(sets)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        linked &= label[:, None] != label[None, :]
        if part.column("i")[0] != part.column("j")[0]:
            linked &= chunk[:, None] != chunk[None, :]
        x, y = np.nonzero(np.triu(linked, 1))
        least = np.arange(len(node))
        while True:  # the least row of each part of the tile
            low = np.minimum(least[x], least[y])
            before = least.copy()
            np.minimum.at(least, x, low)
            np.minimum.at(least, y, low)
            least = least[least]
            if (least == before).all():
                break
        moved = np.flatnonzero(least != np.arange(len(node)))
        return pa.Table.from_arrays([pa.array(node[moved]), pa.array(node[least[moved]])], schema=schema)

    return run


def _tiles(left: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Joins among the members of buckets with many of them unjoined, all compared, chunk by chunk."""
    many = left.where(F.col("others") > FEW).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    sets = texts.join(many.select("node").distinct(), "node", "left_semi").mapInArrow(_sets, "node bigint, hashes array<bigint>")
    sets = materialize(sets, "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = many.select("node", "label", "key", "chunk", other)
    dealt = dealt.select("node", "label", "key", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    tiles = dealt.join(sets, "node").select("node", "label", "key", "chunk", "i", "j", "hashes")
    return materialize(tiles.groupBy("key", "i", "j").applyInArrow(_tile(percent), "a bigint, b bigint"), "joins")


def _verified(texts: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole texts are alike enough."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = materialize(texts.join(ends, "node", "left_semi"), "compared")
    with_b = edges.join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(with_both.select("a", "b", "text_a", "text_b").mapInArrow(_like(percent), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Texts are linked if the sets of their five-word shingles share ``percent`` of their union or more; component_id is
    the least doc_id that links reach. A text of fewer than five words has one shingle, all of it; an empty or null
    text has none and is linked with nothing. Equal word sequences, repeated rows among them, are one class, whose
    links are found once. Texts that share a doc_id are classes of their own, each with its links. Rows without doc_id
    take part in no link and have neither component nor ``kept``. An empty table gives an empty result. A text of any
    length is one value of a Python worker, which takes some ten bytes for each of its own at most.

    Scale: one narrow pass makes sketches and keeps normal texts; classes of equal texts are aggregated before anything
    else, partially on the map side, so a third of all rows being copies costs one row a partition. Bucket hubs are also
    aggregates, and a bucket's members meet its hubs, not one another: edges are linear in the members, in each of ROUNDS
    rounds at most. Then every member of a bucket that isn't joined to its largest part is compared with all members:
    pair by pair if there are FEW of them, else in tiles of two chunks of bounded size, whose common shingles are counted
    by matrix products, so that no row is made for a pair. That rest takes time with the square of a bucket of unlike
    members, as no fewer comparisons rule a link out. Joins that can have a hot key have an exchange on either side for
    adaptive execution to split. Only texts of candidates are compared.
    """
    return _labelled(docs, percent).drop("same")


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of near_duplicates with ``same``, a hash of the text as it is: rows of one doc_id and text share a lot."""
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("same"), "text")
    rows = base.mapInArrow(_sketched, "doc_id bigint, same bigint, n_shingles bigint, digest binary, bands array<bigint>, normal binary")
    rows = materialize(rows.withColumn("tag", F.monotonically_increasing_id()), "sketch")
    classes = (
        rows.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.min("tag").alias("tag"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", "n", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("key").alias("bucket"))
    members = members.join(sizes, members.key == sizes.bucket).select("node", "n", "key")
    members = materialize(members, "members")
    # Texts that share a bucket leave the sketches once, one of each class; a round reads those that it compares.
    wanted = members.select("node").distinct().join(classes.select("node", "tag"), "node")
    texts = materialize(rows.select("tag", F.col("normal").alias("text")).join(wanted, "tag").select("node", "text"), "texts")
    labels = links = tested = None
    for number in range(ROUNDS):
        edges = materialize(_stars(members, labels, links, tested, number, percent), "candidates")
        new = _verified(texts, edges, percent)
        if number and not new.limit(1).count():
            break
        links = new if links is None else links.union(new)
        tested = edges if tested is None else tested.union(edges)
        labels = _joined(labels, new)
    # What stars left: all members of a bucket that aren't joined yet are compared with all others of it.
    left = _unjoined(members, labels)
    edges = materialize(_meetings(left, tested, percent), "candidates")
    labels = _joined(labels, _verified(texts, edges, percent).union(_tiles(left, texts, percent)))

    # A component has the least doc_id of its classes.
    named = labels.join(classes.select("node", "digest", "first"), "node")
    named = materialize(named.select("label", "digest", "first"), "labelled")
    least = materialize(named.groupBy("label").agg(F.min("first").alias("component")), "least")
    found = named.join(least, "label").select("digest", "component")
    rest = classes.join(labels, "node", "left_anti").select("digest", F.col("first").alias("component"))
    found = materialize(found.union(rest), "components")
    plain = rows.select("doc_id", "same", "n_shingles", "digest")
    return plain.join(found, "digest", "left").select(
        "doc_id",
        "same",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"),
    )


def _joined(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """Labels of the components once the new links are among them: known components enter as stars."""
    edges = new.select("a", "b")
    return connected_components(edges if labels is None else edges.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and size of every document, linked at 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that a document of lower doc_id in their component stands for.

    Rows repeated with the same doc_id and text are one document and stay or go together; texts that share a doc_id are
    documents of their own, each judged by itself; rows without doc_id stay.
    """
    plain, names = set_aside(docs, "doc_id", "text")
    gone = _labelled(plain.select("doc_id", "text"), percent).where("not kept").select(F.col("doc_id").alias("__gone"), "same").distinct()
    here = (F.col("doc_id").cast("long") == F.col("__gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("same"))
    return plain.join(gone, here, "left_anti").select(*names).toDF(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(c.low, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""
