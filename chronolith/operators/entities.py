"""Identity, version families, fuzzy matches, and the versioned store with its audit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import likeness
from chronolith.functions import text as T
from chronolith.functions.likeness import ratio
from chronolith.shared import global_rank, materialize

DUPLICATE, EXISTING, RELATED = 0.92, 0.75, 0.55
FIELD_WEIGHTS = (("name", 0.35), ("objective", 0.30), ("actor", 0.10), ("flow", 0.15), ("trigger", 0.10))
SHARED_BONUS = 0.05
#: Candidates, and rows of the store, that one step of matching holds.
TILE, STORE_TILE = 16, 128
#: Up to so many tiles of the store are all met; of more, sums of so many make a block.
FEW_TILES, SUM_BLOCK = 4, 512
#: Classes of characters that a tile is summed up by.
CLASSES = 64
#: A word of more names than this joins no names by itself.
HOT = 1_000
#: The place of a row of the store that has none.
LAST = 2**62
#: What names of outputs begin with; fixed values.
OUTPUT_PREFIXES = ("Capsula-", "CapsulaExtensa-")
STORE_KEYS = ("videos", "actors", "systems", "functionalities", "business_rules", "use_cases", "relationships", "analysis_history")


def content_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def classify_videos(new: DataFrame, known: DataFrame, *, latest_is_last: bool = False, band: float = 0.02) -> DataFrame:
    """status, match, suggested_version of each new row (video_id, file_name, duration_seconds) by the known ones.

    EXACT_DUPLICATE by content; else, in its version family, LIKELY_DUPLICATE of the first whose length is within the
    band of the stored one, both lengths known; else NEW_VERSION of the highest version (or of the last row); else
    NEW_VIDEO. A name of suffixes only has no family. known: also version and ord. Each known table is aggregated to a
    row a key before it is joined, lengths to a row a family and length, and no pairs are made of a family's lengths.
    """
    # Names go through some expressions a row, and a small file would be one task: rows are dealt before.
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = new.repartition(tasks).withColumn("family", T.family(F.col("file_name"))).withColumn("__d", F.col("duration_seconds").cast("double"))
    old = known.select("video_id", "ord", "version", "file_name", "duration_seconds").repartition(tasks)
    old = materialize(old.withColumn("family", T.family(F.col("file_name"))).drop("file_name"), "known")
    exact = old.groupBy("video_id").agg(F.min_by("video_id", "ord").alias("exact"))
    last = F.struct("ord") if latest_is_last else F.struct(F.coalesce("version", F.lit(1)), -F.col("ord"))
    fams = old.where("family <> ''").groupBy("family").agg(F.max_by("video_id", last).alias("parent"), F.max_by(F.coalesce("version", F.lit(1)), last).alias("parent_version"))
    stored = old.where("family <> '' and duration_seconds <> 0 and ord is not null").groupBy("family", F.col("duration_seconds").cast("double").alias("d"))
    near = _first_within(n.select("family", F.col("__d").alias("d")).where("family <> '' and d <> 0").distinct(), stored.agg(F.min(F.struct("ord", "video_id")).alias("first")), band)
    near = near.select("family", F.col("d").alias("__d"), F.col("first.video_id").alias("likely"))
    out = n.join(exact, "video_id", "left").join(fams, "family", "left").join(near, ["family", "__d"], "left")
    status = F.when(F.col("exact").isNotNull(), "EXACT_DUPLICATE").when(F.col("likely").isNotNull(), "LIKELY_DUPLICATE").when(F.col("parent").isNotNull(), "NEW_VERSION").otherwise("NEW_VIDEO")
    match = F.coalesce("exact", "likely", "parent")
    version = F.when(status == "NEW_VERSION", F.col("parent_version") + 1)
    return out.select(*new.columns, "family", status.alias("status"), match.alias("match"), version.cast("int").alias("suggested_version"))


def _first_within(asked: DataFrame, stored: DataFrame, band: float) -> DataFrame:
    """For each asked length (family, d) the least ``first`` of the family's stored lengths (family, d, first) that have it in
    their band; lengths without any are left out. Both have a row a family and length.

    The lengths that qualify lie between two ends. Places on a scale that is even below 1 and logarithmic above are cut into
    bins as wide as the band, so the ends are in two bins: the answer is the least of the first bin from the lower end on,
    of the last one up to the upper end, and of the two bins or so in between, which are summed up. Only lengths so far below
    zero that their digits are wider than the band have both ends in one bin and meet its lengths one by one.
    """
    finite = lambda rows: rows.where(~F.isnan("d") & (F.abs("d") < float("inf")))
    asked, stored = finite(asked), finite(stored)
    if not 1e-6 <= band < 0.5:  # ends that may be in one bin, or not be found to the last digit
        pairs = asked.join(stored.select("family", F.col("d").alias("s"), "first"), "family")
        return pairs.where(F.abs(F.col("s") - F.col("d")) / F.greatest("s", F.lit(1.0)) <= band).groupBy("family", "d").agg(F.min("first").alias("first"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = _band_ends(batch.column("d").to_numpy(zero_copy_only=False), band)
            yield pa.RecordBatch.from_pydict({"family": batch.column("family"), "d": batch.column("d"), "lo": pa.array(lo), "hi": pa.array(hi)})

    binned = lambda v: F.floor(F.when(v <= 1, v).otherwise(1 + F.log(v)) / band)
    asked = asked.mapInArrow(ends, "family string, d double, lo double, hi double")
    asked = materialize(asked.withColumn("lo_bin", binned(F.col("lo"))).withColumn("hi_bin", binned(F.col("hi"))), "bands")
    stored = materialize(stored.withColumn("bin", binned(F.col("d"))), "lengths")
    known = stored.select("family", "bin", F.col("d").alias("end"), "first", F.lit(None).cast("double").alias("d"))

    def at_end(end: str, order: Column) -> DataFrame:
        mine = asked.where("lo_bin < hi_bin").select("family", "d", F.col(end).alias("end"), F.col(f"{end}_bin").alias("bin"))
        rows = known.unionByName(mine, allowMissingColumns=True)
        upto = Window.partitionBy("family", "bin").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("first", F.min("first").over(upto)).where("d is not null").select("family", "d", "first")

    between = asked.where("hi_bin - lo_bin > 1").select("family", "d", F.explode(F.sequence(F.col("lo_bin") + 1, F.col("hi_bin") - 1)).alias("bin"))
    whole = between.join(stored.groupBy("family", "bin").agg(F.min("first").alias("first")), ["family", "bin"]).select("family", "d", "first")
    single = asked.where("lo_bin = hi_bin").withColumnRenamed("lo_bin", "bin").join(known.drop("d"), ["family", "bin"]).where("end between lo and hi").select("family", "d", "first")
    found = at_end("lo", F.col("end").desc()).union(at_end("hi", F.col("end").asc())).union(whole).union(single)
    return found.where("first is not null").groupBy("family", "d").agg(F.min("first").alias("first"))


def _band_ends(x: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest number d with abs(d - x) / max(d, 1) <= band, for bands below a half.

    Rounded as it is, that quotient never falls with the distance of d from x, so each end is found by halving, down to
    neighbouring numbers, between x and one that is too far away.
    """
    order = lambda bits: np.where(bits < 0, np.int64(-(2**63)) - bits, bits)  # noqa: E731  of numbers as their bits, and back
    number = lambda places: order(places).view(np.float64)
    out = []
    for far in (x - 2 * band * np.maximum(np.abs(x), 1.0), x + 4 * band * np.maximum(np.abs(x), 1.0)):
        inside, outside = order(x.view(np.int64)), order(far.view(np.int64))
        for _ in range(64):
            middle = (inside >> 1) + (outside >> 1) + (inside & outside & 1)
            d = number(middle)
            good = np.abs(d - x) / np.maximum(d, 1.0) <= band
            inside, outside = np.where(good, middle, inside), np.where(good, outside, middle)
        out.append(number(inside))
    return out[0], out[1]


def register_videos(known: DataFrame, new: DataFrame) -> DataFrame:
    """The known rows and those new ones whose content isn't known."""
    return known.unionByName(new.dropDuplicates(["video_id"]).join(known, "video_id", "left_anti"), allowMissingColumns=True)


def similarity(mine: str = "c", theirs: str = "e") -> Column:
    """Weighted likeness of two structs of fields; fields empty on both sides don't count; shared functions add."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for field, weight in FIELD_WEIGHTS:
        a, b = (F.coalesce(F.col(f"{s}.{field}"), F.lit("")) for s in (mine, theirs))
        counts = (a != "") | (b != "")
        total = total + F.when(counts, weight * ratio(a, b)).otherwise(0.0)
        weights = weights + F.when(counts, weight).otherwise(0.0)
    none = F.array().cast("array<string>")
    shared = F.arrays_overlap(*[F.coalesce(F.col(f"{s}.functionalities"), none) for s in (mine, theirs)])
    bonus = F.when(F.coalesce(shared, F.lit(False)), SHARED_BONUS).otherwise(0.0)
    return F.when(weights + bonus > 0, (total + bonus) / (weights + bonus)).otherwise(0.0)


def status_of(score: Column) -> Column:
    return F.when(score >= DUPLICATE, "DUPLICATE").when(score >= EXISTING, "EXISTING").when(score >= RELATED, "RELATED").otherwise("NEW")


def name_words() -> Column:
    """Words of the name of three letters or more."""
    return F.array_distinct(F.filter(F.split(T.plain(F.lower(F.coalesce("name", F.lit("")))), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3))


class _Rows:
    """Rows of either side made ready for comparison: plain texts by field, which fields are filled, functions."""

    def __init__(self, rows: list[dict]):
        raw = [[r[f] or "" for r in rows] for f, _ in FIELD_WEIGHTS]
        self.filled = np.array([[t != "" for t in texts] for texts in raw], bool).reshape(len(raw), len(rows))
        self.texts = [[likeness.plain(t) for t in texts] for texts in raw]
        self.sizes = np.array([[len(t) for t in texts] for texts in self.texts], np.int64).reshape(len(raw), len(rows))
        self.functions = [{x for x in r["functionalities"] or () if x is not None} for r in rows]

    def counts(self, field: int, classes: np.ndarray | None = None) -> np.ndarray:
        """How often each text has each of the characters, or each of ``CLASSES`` classes of them."""
        codes = np.frombuffer("".join(self.texts[field]).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(len(self.texts[field])), self.sizes[field])
        if classes is None:
            place, wide = codes % CLASSES, CLASSES
        else:
            place, wide = np.searchsorted(classes, codes), len(classes)
        return np.bincount(rows * wide + place, minlength=len(self.texts[field]) * wide).reshape(-1, wide)

    def bits(self) -> np.ndarray:
        """64 bits a row, of which two rows with a function in common have one in common."""
        return np.array([sum(1 << b for b in {zlib.crc32(x.encode("utf-8", "surrogatepass")) % 63 for x in own}) for own in self.functions], np.int64)


def _weigh(ratios: np.ndarray, on: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The weighted likeness from the ratios by field; never falls when a ratio rises, in floating point too."""
    total, weights = np.zeros(ratios.shape[1:]), np.zeros(ratios.shape[1:])
    for r, use, (_, weight) in zip(ratios, on, FIELD_WEIGHTS, strict=True):
        total, weights = total + np.where(use, weight * r, 0.0), weights + np.where(use, weight, 0.0)
    bonus = np.where(shared, SHARED_BONUS, 0.0)
    return np.where(weights + bonus > 0, (total + bonus) / np.maximum(weights + bonus, 1e-300), 0.0)


def _best_in_tile(mine: _Rows, theirs: _Rows, ords: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate (row of the best match or -1, its score, how many rows it was compared with).

    Two texts have no more in common than their characters, whatever their order. So rows are tried from the highest such
    bound on, a few more in each round, and a row is left out where its bound is below the best score so far, or the
    floor, the score of a match elsewhere; so again after each field, short ones first. Nothing that could win is left out.
    """
    bound = np.zeros((len(FIELD_WEIGHTS), mine.sizes.shape[1], theirs.sizes.shape[1]))
    for f in range(len(FIELD_WEIGHTS)):
        chars = np.unique(np.frombuffer("".join(mine.texts[f]).encode("utf-32-le", "surrogatepass"), np.uint32))
        if not len(chars):
            continue
        chars = np.append(chars, np.uint32(0xFFFFFFFF))  # whatever isn't of the candidates
        own, other = mine.counts(f, chars)[:, :-1], theirs.texts[f]
        codes = np.frombuffer("".join(other).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.searchsorted(chars, codes)
        place = np.where(chars[place] == codes, place, len(chars) - 1)
        rows = np.repeat(np.arange(len(other)), theirs.sizes[f])
        stored = np.bincount(rows * len(chars) + place, minlength=len(other) * len(chars)).reshape(-1, len(chars))[:, :-1]
        both = mine.sizes[f][:, None] + theirs.sizes[f][None, :]
        common = np.array([np.minimum(c, stored).sum(axis=1) for c in own])
        bound[f] = 2.0 * common / np.maximum(both, 1)
    on = mine.filled[:, :, None] | theirs.filled[:, None, :]
    shared = np.array([[not a.isdisjoint(b) for b in theirs.functions] for a in mine.functions])
    most = _weigh(bound, on, shared)
    cheapest = np.argsort(mine.sizes.mean(axis=1) * theirs.sizes.mean(axis=1))
    order = np.lexsort((np.broadcast_to(ords, most.shape), -most), axis=1)
    ranked = np.take_along_axis(most, order, axis=1)
    n = len(order)
    best, score, met, reached, take = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), 0, 1
    while reached < order.shape[1]:
        ahead = ranked[:, reached : reached + take]
        c, k = np.nonzero((ahead > 0) & (ahead >= np.maximum(score, floor)[:, None]))
        if not len(c):
            break
        e = order[c, reached + k]
        told = bound[:, c, e]
        met += np.bincount(c, minlength=n)
        for f in cheapest:
            some = np.flatnonzero(told[f] > 0)
            told[f, some] = likeness.ratios([mine.texts[f][i] for i in c[some]], [theirs.texts[f][i] for i in e[some]])
            likely = _weigh(told, on[:, c, e], shared[c, e])
            stays = (likely > 0) & (likely >= np.maximum(score, floor)[c])
            c, e, told, likely = c[stays], e[stays], told[:, stays], likely[stays]
        for i, (row, found) in enumerate(zip(c, e, strict=True)):
            if likely[i] > score[row] or (likely[i] == score[row] and ords[found] < ords[best[row]]):
                best[row], score[row] = found, likely[i]
        reached, take = reached + take, take * 4
    return best, score, met


def _best_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows c, e (tiles), who (places in c, or null: all), floor: place and best match of each of them."""
    for batch in batches:
        for row in range(batch.num_rows):
            tile, c = batch["__c"][row].as_py(), batch["c"][row].as_py()
            e = sorted(batch["e"][row].as_py(), key=lambda r: r["use_case_id"] or "")
            who, floor = batch["who"][row].as_py(), batch["floor"][row].as_py()
            who = list(range(len(c))) if who is None else who
            ords = np.array([LAST if r["ord"] is None else r["ord"] for r in e], np.int64)
            best, score, met = _best_in_tile(_Rows([c[i] for i in who]), _Rows(e), ords, np.array(floor or [0.0] * len(who)))
            ids = [e[b]["use_case_id"] if b >= 0 else None for b in best]
            out = [pa.array([tile] * len(who), pa.int32()), pa.array(who, pa.int32()), pa.array(ids, pa.string()), pa.array(score), pa.array([int(ords[b]) if b >= 0 else None for b in best], pa.int64()), pa.array(met)]
            yield pa.record_batch(out, ["__c", "at", "use_case_id", "score", "ord", "met"])


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile of the store what bounds the score of its rows: by field the greatest counts of classes of characters,
    the least and greatest length of a text, and whether a row lacks the field; bits of functions."""
    for batch in batches:
        sums, bits = [], []
        for row in range(batch.num_rows):
            rows = _Rows(batch["e"][row].as_py())
            parts = []
            for f in range(len(FIELD_WEIGHTS)):
                some = rows.sizes[f][rows.sizes[f] > 0]
                parts.append(np.concatenate([rows.counts(f).max(axis=0), [some.min() if len(some) else 0, some.max() if len(some) else 0, not rows.filled[f].all()]]))
            sums.append(np.concatenate(parts).astype(np.int32).tobytes())
            bits.append(int(np.bitwise_or.reduce(rows.bits())))
        yield pa.record_batch([batch["__e"], pa.array(sums, pa.binary()), pa.array(bits, pa.int64())], ["__e", "sums", "bits"])


def _bounds(rows: _Rows, tiles: list[dict]) -> np.ndarray:
    """Of each row and tile, by its sums, a score that no row of the tile is above."""
    sums = np.stack([np.frombuffer(t["sums"], np.int32) for t in tiles]).reshape(len(tiles), len(FIELD_WEIGHTS), CLASSES + 3).astype(np.int64)
    least, greatest, lacking = sums[:, :, CLASSES].T, sums[:, :, CLASSES + 1].T, sums[:, :, CLASSES + 2].T.astype(bool)
    ratios, on = (np.zeros((len(FIELD_WEIGHTS), rows.sizes.shape[1], len(tiles)), t) for t in (np.float64, bool))
    for f in range(len(FIELD_WEIGHTS)):
        own, sizes = rows.counts(f), rows.sizes[f][:, None]
        common = np.array([np.minimum(c, sums[:, f, :CLASSES]).sum(axis=1) for c in own])
        # The ratio rises with the length of the other text as long as all of it is common, and falls after that.
        length = np.clip(common, least[f], greatest[f])
        ratios[f] = 2.0 * np.minimum(common, length) / np.maximum(sizes + length, 1)
        # A field that neither side fills isn't counted, which is never worse than nothing in common.
        on[f] = rows.filled[f][:, None] | ~lacking[f][None, :]
    shared = (rows.bits()[:, None] & np.array([t["bits"] for t in tiles], np.int64)[None, :]) != 0
    return _weigh(ratios, on, shared) * (1 + 1e-12)


def _most_promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each candidate in c the tile of highest bound among those summed up in s."""
    for batch in batches:
        for row in range(batch.num_rows):
            tiles = sorted(batch["s"][row].as_py(), key=lambda t: t["__e"])
            bound = _bounds(_Rows(batch["c"][row].as_py()), tiles)
            first, n = bound.argmax(axis=1), len(bound)
            out = [pa.array([batch["__c"][row].as_py()] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array([tiles[k]["__e"] for k in first], pa.int64()), pa.array(bound[np.arange(n), first])]
            yield pa.record_batch(out, ["__c", "at", "__e", "bound"])


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles summed up in s whose bound reaches the score (``found``) of a candidate, with these candidates."""
    for batch in batches:
        for row in range(batch.num_rows):
            tile, tiles = batch["__c"][row].as_py(), batch["s"][row].as_py()
            found = {x["at"]: (x["score"], x["__e"]) for x in batch["found"][row].as_py()}
            bound = _bounds(_Rows(batch["c"][row].as_py()), tiles)
            floor, done = np.array([found[k][0] for k in range(len(bound))]), np.array([found[k][1] for k in range(len(bound))])
            meets = (bound > 0) & (bound >= floor[:, None]) & (done[:, None] != np.array([t["__e"] for t in tiles])[None, :])
            chosen = np.flatnonzero(meets.any(axis=0))
            who = [np.flatnonzero(meets[:, k]) for k in chosen]
            out = [pa.array([tile] * len(who), pa.int32()), pa.array([tiles[k]["__e"] for k in chosen], pa.int64()), pa.array([w.tolist() for w in who], pa.list_(pa.int32())), pa.array([floor[w].tolist() for w in who], pa.list_(pa.float64()))]
            yield pa.record_batch(out, ["__c", "__e", "who", "floor"])


def _best_pairs(candidates: DataFrame, store: DataFrame, fields: list[str]) -> DataFrame:
    """cand_id, use_case_id, score, ord of the best matches in the tiles that each candidate meets, and ``met``, the rows met."""
    n = max(1, -(-candidates.count() // TILE))
    deal = F.pmod(F.xxhash64("cand_id"), F.lit(n)).cast("int").alias("__c")
    mine = materialize(candidates.groupBy(deal).agg(F.collect_list(F.struct("cand_id", *fields)).alias("c")), "candidates")
    # Rows that lack the same fields and are of like lengths share a tile, so that its bounds are close.
    size = lambda f: F.length(F.coalesce(F.col(f), F.lit("")))
    lacks = sum((size(f) == 0).cast("int") * 2**i for i, (f, _) in enumerate(FIELD_WEIGHTS))
    like = store.select("use_case_id", F.col("ord").cast("long").alias("ord"), *fields, lacks.alias("__lacks"), F.round(F.log1p(size("objective")) * 4).alias("__long"), size("name").alias("__name"))
    like = global_rank(like, ["__lacks", "__long", "__name", "use_case_id"], "__rank")
    tile = F.expr(f"__rank div {STORE_TILE}").cast("long").alias("__e")
    theirs = materialize(like.groupBy(tile).agg(F.collect_list(F.struct("use_case_id", "ord", *fields)).alias("e")), "store")
    tiles = max(1, theirs.count())
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = "__c int, at int, use_case_id string, score double, ord bigint, met bigint"
    compare = lambda pairs: pairs.repartition(tasks, "__c", "__e").select("__c", "c", "e", "who", "floor").mapInArrow(_best_of_tiles, best)
    if tiles <= FEW_TILES:
        each = mine.withColumn("__e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).join(theirs, "__e")
        found = compare(each.withColumn("who", F.lit(None).cast("array<int>")).withColumn("floor", F.lit(None).cast("array<double>")))
    else:
        sums = materialize(theirs.mapInArrow(_summed_up, "__e bigint, sums binary, bits bigint"), "sums")
        blocks = sums.groupBy(F.expr(f"__e div {SUM_BLOCK}").alias("__b")).agg(F.collect_list(F.struct("__e", "sums", "bits")).alias("s"))
        all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((tiles - 1) // SUM_BLOCK).cast("long")))
        met = lambda side: side.withColumn("__b", all_blocks).join(blocks, "__b").repartition(tasks, "__c", "__b")
        first = met(mine).select("__c", "c", "s").mapInArrow(_most_promising, "__c int, at int, __e bigint, bound double")
        first = first.groupBy("__c", "at").agg(F.max_by("__e", F.struct("bound", -F.col("__e"))).alias("__e"))
        first = materialize(first, "first-tiles")
        who = first.groupBy("__c", "__e").agg(F.array_sort(F.collect_list("at")).alias("who")).withColumn("floor", F.lit(None).cast("array<double>"))
        one = materialize(compare(who.join(mine, "__c").join(theirs, "__e")), "first-matches")
        score = one.join(first, ["__c", "at"]).groupBy("__c").agg(F.collect_list(F.struct("at", "score", "__e")).alias("found"))
        rest = met(mine.join(score, "__c")).select("__c", "c", "s", "found").mapInArrow(_left_over, "__c int, __e bigint, who array<int>, floor array<double>")
        found = one.unionByName(compare(rest.join(mine, "__c").join(theirs, "__e")))
    ids = mine.select("__c", F.posexplode("c").alias("at", "row")).select("__c", "at", "row.cand_id")
    return found.join(ids, ["__c", "at"])


def match_use_cases(candidates: DataFrame, store: DataFrame, block: Column | None = None, store_block: Column | None = None, *, with_met: bool = False) -> DataFrame:
    """status, use_case_id and score of each candidate's best match in the store; the first of equals; NEW has no match.

    Both have name, objective, actor, flow, trigger, functionalities; candidates a key ``cand_id``, the store use_case_id
    and ord. The best match is that of the whole store. It lies in tiles of ``STORE_TILE`` like rows, each summed up by what
    bounds the score of its rows. A candidate is compared with the tile of highest bound, and then only with tiles whose
    bound reaches the score found there; within a tile, with rows by their own bounds. Candidates go in tiles of about
    ``TILE``. ``with_met`` adds ``met``, the rows of the store it was compared with.

    Where blocks (arrays, of both sides) are given, only pairs that share one are scored, and candidates that share none
    with any row are NEW with score 0.
    """
    fields = [f for f, _ in FIELD_WEIGHTS] + ["functionalities"]
    if block is None and store_block is None:
        pairs = _best_pairs(candidates, store, fields)
    else:
        c, e = F.struct(*fields).alias("c"), F.struct(*fields).alias("e")
        mine = candidates.select("cand_id", c, F.explode(block).alias("__b"))
        pairs = mine.join(store.select("use_case_id", "ord", e, F.explode(store_block).alias("__b")), "__b").dropDuplicates(["cand_id", "use_case_id"])
        pairs = pairs.withColumn("score", similarity()).withColumn("met", F.lit(1))
    place = F.when(F.col("score") > 0, F.struct("score", -F.coalesce(F.col("ord").cast("long"), F.lit(LAST))))
    best = pairs.groupBy("cand_id").agg(F.max_by(F.struct("use_case_id", "score"), place).alias("m"), F.sum("met").alias("met"))
    out = candidates.join(best, "cand_id", "left").withColumn("score", F.coalesce("m.score", F.lit(0.0)))
    out = out.withColumn("status", status_of(F.col("score")))
    more = [F.coalesce("met", F.lit(0)).alias("met")] if with_met else []
    return out.select("cand_id", "status", F.when(F.col("status") != "NEW", F.col("m.use_case_id")).alias("use_case_id"), "score", *more)


def next_ids(rows: DataFrame, known: DataFrame, key: str, prefix: str, order: list[str]) -> DataFrame:
    """Adds ids PREFIX-001 on, after the highest known one, in the order of ``order``; ties get theirs in any order."""
    top = known.agg(F.coalesce(F.max(F.regexp_extract(key, rf"^{prefix}-(\d+)", 1).try_cast("long")), F.lit(0)).alias("__top"))
    ranked = global_rank(rows, order, "__rank").crossJoin(F.broadcast(top))
    return ranked.withColumn(key, F.format_string(f"{prefix}-%03d", F.col("__top") + F.col("__rank") + 1)).select(*[F.col(c) for c in rows.columns if c != key], key)


def add_evidence(store: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store with the evidence appended, in order, to its use cases; rows of evidence whose use case isn't there).

    evidence: use_case_id, ord, item (struct like the elements of the store's ``evidence``).
    """
    lists = evidence.groupBy("use_case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]).alias("__more"))
    out = store.join(lists, "use_case_id", "left")
    empty = F.col("evidence")
    out = out.withColumn("evidence", F.when(F.col("__more").isNull(), empty).otherwise(F.concat(F.coalesce(empty, F.slice("__more", 1, 0)), "__more"))).drop("__more")
    return out.select(*store.columns), evidence.join(store, "use_case_id", "left_anti")


def update_use_cases(store: DataFrame, changes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(store with the changes, audit rows with the rows as they were): null leaves a field, rules are merged, version + 1.

    changes: use_case_id, reason, and any fields of the store; one row a use case.
    """
    fields = [c for c in changes.columns if c in store.columns and c != "use_case_id"]
    renamed = changes.select("use_case_id", "reason", *[F.col(c).alias(f"__{c}") for c in fields])
    both = store.join(renamed, "use_case_id", "left").withColumn("__hit", F.col("reason").isNotNull())
    new = {}
    for c in store.columns:
        if c in fields:
            if c == "business_rules":
                none = F.array().cast(store.schema[c].dataType)
                merged = F.array_sort(F.array_union(F.coalesce(c, none), F.col(f"__{c}")))
                new[c] = F.when(F.col(f"__{c}").isNotNull(), merged).otherwise(F.col(c))
            else:
                new[c] = F.coalesce(f"__{c}", c)
        elif c == "version":
            new[c] = F.when(F.col("__hit"), F.coalesce(F.col(c), F.lit(1)) + 1).otherwise(F.col(c)).cast(store.schema[c].dataType)
        else:
            new[c] = F.col(c)
    audit = both.where("__hit").select(at.alias("date"), F.lit("UPDATED").alias("action"), F.col("use_case_id").alias("entity"), "reason", F.to_json(F.struct(*store.columns)).alias("previous"))
    return both.select(*[v.alias(c) for c, v in new.items()]), audit


def audit_of(rows: DataFrame, action: str, entity: str, reason: Column, at: Column) -> DataFrame:
    return rows.select(at.alias("date"), F.lit(action).alias("action"), F.col(entity).alias("entity"), reason.alias("reason"), F.lit(None).cast("string").alias("previous"))


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the store whose key isn't among the new ones, and the new ones."""
    return store.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_by_name(store: DataFrame, new: DataFrame, key: str, stamp: Column) -> DataFrame:
    """Full merge: fields of new rows stand before old ones; ``registered`` of the first time stays, ``updated`` is now."""
    fields = [c for c in dict.fromkeys([*store.columns, *new.columns]) if c not in (key, "registered", "updated")]
    a = store.select(key, *[F.col(c).alias(f"a_{c}") for c in store.columns if c != key])
    b = new.select(key, *[F.col(c).alias(f"b_{c}") for c in new.columns if c != key], F.lit(True).alias("__new"))
    both = a.join(b, key, "full")
    side = lambda s, c: F.col(f"{s}_{c}") if f"{s}_{c}" in both.columns else F.lit(None)
    out = [F.coalesce(side("b", c), side("a", c)).alias(c) for c in fields]
    registered = F.coalesce(side("a", "registered"), F.when(F.col("__new"), stamp))
    updated = F.when(F.col("__new"), stamp).otherwise(side("a", "updated"))
    return both.select(key, *out, registered.alias("registered"), updated.alias("updated"))


def token_match(left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_key: str, right_name: str) -> DataFrame:
    """For each row of left the row of right whose name has most in common: shared words, again if all are there, 10 if equal.

    Of equals, the first by right_key. Names that are the same are one row of right. Pairs are those that share a word of at
    most ``HOT`` names of right, or the whole compact name: an equi-join. What shares only hotter words has a score that their
    sets alone decide, so these meet as sets: the sets of left with the sets of right, each of which stands for the first of
    its rows. A pair that shares rarer words too has at least that score, and the other join has it in full.
    """
    l = left.select(left_key, T.tokens(F.col(left_name)).alias("lt"), T.compact(F.col(left_name)).alias("lc"))
    r = right.select(right_key, T.tokens(F.col(right_name)).alias("rt"), T.compact(F.col(right_name)).alias("rc")).where(F.size("rt") > 0)
    r = r.groupBy("rt", "rc").agg(F.min(right_key).alias(right_key))
    hot = r.select(F.explode("rt").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("w")
    keys = lambda t, c: F.array_distinct(F.concat(F.transform(t, lambda x: F.concat(F.lit("t:"), x)), F.array(F.concat(F.lit("c:"), c))))
    some_hot = bool(hot.head(1))
    mine, theirs = l.withColumn("k", F.explode(keys(F.col("lt"), F.col("lc")))), r.withColumn("k", F.explode(keys(F.col("rt"), F.col("rc"))))
    if some_hot:
        hot = materialize(hot, "hot-words")
        theirs = theirs.join(hot.select(F.concat(F.lit("t:"), "w").alias("k")), "k", "left_anti")
    pairs = mine.join(theirs, "k").dropDuplicates([left_key, right_key])
    shared = F.size(F.array_intersect("lt", "rt"))
    whole = F.when(F.size(F.array_except("rt", "lt")) == 0, F.size("rt")).otherwise(0)
    equal = F.when((F.col("lc") != "") & (F.col("lc") == F.col("rc")), 10).otherwise(0)
    pairs = pairs.withColumn("score", shared + whole + equal).where("score > 0").select(left_key, right_key, "score")
    if some_hot:
        pairs = pairs.unionByName(_hot_pairs(l, r, hot, left_key, right_key))
    w = Window.partitionBy(left_key).orderBy(F.col("score").desc(), right_key)
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select(left_key, right_key, "score")


def _hot_pairs(l: DataFrame, r: DataFrame, hot: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """For each row of left, the best row of right by hot words alone."""
    sets = lambda side, key, t, *more: side.select(key, *more, F.explode(t).alias("w")).join(hot, "w").groupBy(key, *more).agg(F.sort_array(F.collect_set("w")).alias("hs"))
    mine = sets(l, left_key, "lt")
    theirs = sets(r.withColumn("size", F.size("rt")), right_key, "rt", "size").withColumn("pure", F.col("size") == F.size("hs"))
    kinds = theirs.groupBy(F.col("hs").alias("rs"), "pure").agg(F.min(right_key).alias(right_key))
    met = mine.select(F.col("hs")).distinct().withColumn("w", F.explode("hs")).join(kinds.withColumn("w", F.explode("rs")), "w").drop("w").dropDuplicates(["hs", "rs", "pure"])
    score = F.size(F.array_intersect("hs", "rs")) + F.when(F.col("pure") & (F.size(F.array_except("rs", "hs")) == 0), F.size("rs")).otherwise(0)
    best = met.withColumn("score", score).groupBy("hs").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col(right_key))).alias("b"))
    return mine.join(best, "hs").select(left_key, F.col(f"b.{right_key}").alias(right_key), (-F.col("b.less")).alias("score"))


def most_specific(outputs: DataFrame, sources: DataFrame, output_key: str, output_name: str, source_key: str, source_name: str) -> DataFrame:
    """Pairs of an output and the sources whose words are all in its name, unless a source with more words claims it.

    An output that has all words of a source has the rarest of them, so pairs come from an equi-join on the word of each
    source that fewest outputs have; a source with a word that no output has claims none. Names with the same words claim the
    same, so sets of words meet, a row each, and outputs and sources come back at the end. Rows grow as names are taken apart,
    which no estimate from a file's size knows, so these joins are told to sort and merge, and nothing is broadcast.
    """
    o = outputs.select(output_key, F.array_sort(T.tokens(F.col(output_name))).alias("ot"))
    s = sources.select(source_key, F.array_sort(T.tokens(F.col(source_name))).alias("st")).where(F.size("st") > 0)
    o, s = materialize(o, "outputs"), materialize(s, "sources")
    sets = s.select("st").distinct()
    words = o.select("ot").distinct().withColumn("k", F.explode("ot"))
    often = words.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rarest = sets.withColumn("k", F.explode("st")).join(often.hint("merge"), "k", "left").groupBy("st").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k"))["k"].alias("k"))
    pairs = materialize(words.join(rarest.hint("merge"), "k").where(F.size(F.array_except("st", "ot")) == 0).select("ot", "st"), "claims")
    stricter = pairs.select(F.col("ot").alias("__o"), F.col("st").alias("__t"))
    beaten = (F.col("ot") == F.col("__o")) & (F.size("__t") > F.size("st")) & (F.size(F.array_except("st", "__t")) == 0)
    claims = pairs.join(stricter.hint("merge"), beaten, "left_anti")
    return o.join(claims.hint("merge"), "ot").join(s.hint("merge"), "st").select(output_key, source_key)


def missing_outputs(registry: DataFrame, files: DataFrame, prefixes=OUTPUT_PREFIXES) -> DataFrame:
    """Files (output) that the registry doesn't know, with slug and canonical topic."""
    from chronolith.functions import rules

    new = files.select("output").distinct().join(registry, "output", "left_anti")
    bare = F.regexp_replace(F.regexp_replace(T.stem(F.col("output")), f"^(?:{'|'.join(sorted(prefixes, key=len, reverse=True))})", ""), r"-\d{2}-\d{2}-\d{4}$", "")
    topic = F.coalesce(rules.canonical_topic(F.col("slug")), F.lit(rules.UNCLASSIFIED))
    return new.withColumn("slug", bare).withColumn("topic", topic).withColumn("origin", F.lit("auto-descubierto"))


def deletable(videos: DataFrame) -> DataFrame:
    """Adds ``decision``: what stands against deleting a video, in order. Nothing is deleted here.

    Columns: registered, processed, new_cases (array), present, confirmed.
    """
    decision = (
        F.when(~F.col("registered"), "BLOCKED_NOT_REGISTERED")
        .when(~F.col("processed"), "BLOCKED_NOT_PROCESSED")
        .when(F.size("new_cases") > 0, "BLOCKED_NEW_CASES")
        .when(~F.col("present"), "SKIP_ABSENT")
        .when(~F.col("confirmed"), "DRY_RUN")
        .otherwise("DELETE")
    )
    return videos.withColumn("decision", decision)
