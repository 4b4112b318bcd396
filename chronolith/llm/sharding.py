"""Sharding along a Hilbert curve over several metadata dimensions. Native: DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, materialize, pick, set_aside, table

BITS = 8


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell given by ``dims`` (each 0 to 2**bits - 1), as a long.

    Gray-code transposition over the bit planes from the highest (Skilling, 2004), as folds over arrays.
    """
    n = len(dims)
    long = lambda c: c.cast("long")
    planes = F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)])
    axes = F.array(*[F.lit(i) for i in range(n)])

    def turn(x: Column, i: Column, q: Column) -> Column:
        low, first, this = q - 1, x[0], F.get(x, i)
        hit = this.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(this).bitwiseAND(low)
        first_now = F.when(hit, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        this_now = F.when(hit, this).otherwise(this.bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, first_now).when(j == i, this_now).otherwise(v))

    start = F.array(*[long(d) for d in dims])
    turned = F.aggregate(planes, start, lambda x, q: F.aggregate(axes, x, lambda y, i: turn(y, i, q)))
    # Gray code: each axis becomes the exclusive or of itself and all before it, then the last one's planes flip all.
    zero = F.lit(0).cast("long")
    gray = F.transform(turned, lambda _, j: F.aggregate(F.slice(turned, 1, j + 1), zero, lambda a, v: a.bitwiseXOR(v)))
    both = F.struct(gray.alias("x"))
    flip = lambda x: F.aggregate(planes, zero, lambda t, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    cell = F.transform(F.array(both), lambda s: F.transform(s["x"], lambda v: v.bitwiseXOR(flip(s["x"]))))[0]
    down = F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, -1, -1)])
    bit = lambda v, q: F.when(v.bitwiseAND(q) != 0, F.lit(1).cast("long")).otherwise(zero)
    done = F.transform(
        F.array(F.struct(cell.alias("x"))),
        lambda s: F.aggregate(down, zero, lambda h, q: F.aggregate(s["x"], h, lambda g, v: g * 2 + bit(v, q))),
    )
    return done[0]


def quantised(lang: Column, source: Column, size: Column) -> list[Column]:
    """Cells of language, source (hashed, so equal values share a cell) and size (logarithmic)."""
    name = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(256))
    log = F.least(F.lit(255), F.floor(F.log2(size.cast("double")) * 8))
    return [name(lang), name(source), log]


def hilbert_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, curve, law, shard, slot, grown_shard of every row of docs (doc_id, text, lang, source).

    Rows in the order of their curve index, then text checksum and doc_id (so equal texts with equal metadata lie side
    by side), are cut into ``shards`` runs whose counts differ by one at most: law ``rows``. A run covers few cells of
    the curve, so filters on language, source and size prune files.

    Null text counts as empty, null language or source as ''. Repeated rows each get their own slot. With fewer rows
    than shards some shards stay empty; an empty table gives an empty result.

    The text is read once, for its size and checksum; narrow rows are written, and these are ranked. The range exchange has doc_id
    among its keys, so a source or group of copies with a third of all rows is spread over many tasks.
    """
    return _ranked(pick(docs, "doc_id", "text", "lang", "source"), shards)


def _ranked(base: DataFrame, shards: int, *carry: str) -> DataFrame:
    """Shards and slots of base (doc_id, text, lang, source, and the columns to carry)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + F.lit(16).cast("long")
    narrow = base.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source", *carry)
    narrow = narrow.withColumn("curve", hilbert_index(quantised(F.col("lang"), F.col("source"), F.col("size"))))
    narrow = materialize(narrow.drop("lang", "source"), "curve")  # the range exchange reads its input twice
    ranked = global_rank(narrow, ["curve", "text_crc32", "doc_id", "size"])
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")  # the least rank of this shard
    cut = ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    return cut.select(
        "doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry,
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write every row of docs, all columns, in one folder for each shard (``shard=0`` and so on), in the order of ``slot``.

    Where docs has columns of these names, in any case, the new ones get underscores behind theirs.

    Rows are written once with a tag, so that those that repeat a doc_id, or have none, are told apart; the ranks of the
    tagged rows are joined back by the tag, and a shard's rows meet in one task.
    """
    plain, names = set_aside(docs, "doc_id", "text", "lang", "source")
    tagged = materialize(plain.withColumn("__tag", F.monotonically_increasing_id()), "tagged")
    at = _ranked(tagged.select("doc_id", "text", "lang", "source", "__tag"), shards, "__tag")
    placed = tagged.join(at.select("__tag", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), "__tag")
    placed = placed.repartition(shards, "__shard").sortWithinPartitions("__shard", "__slot")
    taken, free = {c.lower() for c in docs.columns}, []
    for name in ("shard", "slot"):
        while name in taken:
            name += "_"
        free.append(name)
    placed.select(*names, "__shard", "__slot").toDF(*docs.columns, *free).write.partitionBy(free[0]).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, in 40 shards."""
    return hilbert_shards(table(spark, sf_dir, "documents"))
