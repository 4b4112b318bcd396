"""Quality gates: rules that give a verdict and its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
MOST_SECONDS, WARN_SECONDS, SIZE, CODECS, MOST_SKIN = 300.0, 45.0, (1280, 720), ("h264", "aac"), 0.045


def verdicts(rows: DataFrame, failures: list[tuple[Column, Column]], warnings: list[tuple[Column, Column]]) -> DataFrame:
    """Adds verdict and reasons: of the failures that hold (condition, reason), or else of the warnings."""
    listed = lambda rules: F.array_compact(F.array(*[F.when(c, r) for c, r in rules])) if rules else F.array().cast("array<string>")
    bad, odd = listed(failures), listed(warnings)
    verdict = F.when(F.size(bad) > 0, FAIL).when(F.size(odd) > 0, WARN).otherwise(PASS)
    return rows.withColumn("verdict", verdict).withColumn("reasons", F.when(F.size(bad) > 0, bad).otherwise(odd))


def verify(checks: DataFrame) -> DataFrame:
    """Verdicts on produced files: exists, seconds, width, height, vcodec, acodec, people_samples; a missing file fails."""
    whole = lambda c: F.format_string("%.0f", F.col(c))
    there = F.col("exists")
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    failures = [
        (~there, F.lit("no existe o pesa 0")),
        (there & (F.col("seconds") > MOST_SECONDS), F.concat(F.lit("duracion "), whole("seconds"), F.lit(f"s > {MOST_SECONDS:.0f}s"))),
        (there & ((F.col("width") != SIZE[0]) | (F.col("height") != SIZE[1])), F.concat(F.lit("resolucion "), size, F.lit(f" != {SIZE[0]}x{SIZE[1]}"))),
        (there & (F.col("vcodec") != CODECS[0]), F.concat(F.lit("video codec "), "vcodec", F.lit(f" != {CODECS[0]}"))),
        (there & (F.coalesce("acodec", F.lit("SIN-AUDIO")) != CODECS[1]), F.concat(F.lit("audio codec "), F.coalesce("acodec", F.lit("SIN-AUDIO")), F.lit(f" != {CODECS[1]}"))),
        (there & (F.col("people_samples") > 0), F.concat(F.lit("PERSONAS: "), F.col("people_samples").cast("string"), F.lit(f" frames con piel>={MOST_SKIN}"))),
    ]
    warnings = [(there & (F.col("seconds") < WARN_SECONDS), F.concat(F.lit("duracion "), whole("seconds"), F.lit("s < 45s (guion corto?)")))]
    return verdicts(checks, failures, warnings)


def overall(results: DataFrame) -> DataFrame:
    """One row: the worst verdict and counts."""
    rank = F.when(F.col("verdict") == FAIL, 2).when(F.col("verdict") == WARN, 1).otherwise(0)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return results.agg(
        F.element_at(F.array(F.lit(PASS), F.lit(WARN), F.lit(FAIL)), worst + 1).alias("verdict"),
        F.count_if(F.col("verdict") == PASS).alias("n_pass"), F.count_if(F.col("verdict") == WARN).alias("n_warn"),
        F.count_if(F.col("verdict") == FAIL).alias("n_fail"), F.count(F.lit(1)).alias("n"),
    )


def skin_summary(samples: DataFrame, key: list[str], skin: str = "skin", most: float = MOST_SKIN) -> DataFrame:
    return samples.groupBy(*key).agg(F.max(skin).alias("skin_max"), F.count_if(F.col(skin) >= most).alias("people_samples"), F.count(F.lit(1)).alias("samples"))


def is_skin(r: Column, g: Column, b: Column, strict: bool = False) -> Column:
    """Whether a colour is of skin; ``strict`` asks for more red than blue by 15 instead of a wide range."""
    base = (r > 95) & (g > 40) & (b > 20) & (F.abs(r - g) > 15) & (r > g) & (r > b)
    return base & ((r - b > 15) if strict else (F.greatest(r, g, b) - F.least(r, g, b) > 15))


def rms(samples: DataFrame, key: list[str], value: str) -> DataFrame:
    return samples.groupBy(*key).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
