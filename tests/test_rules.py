"""The literals that stand guard before regular expressions never rule out a match."""

from pyspark.sql import functions as F

from chronolith.functions import rules


def test_guards_rule_out_no_match(spark):
    samples = ["excel", "EXCEL 3", "fila a columna", "Épica", "épica", "éapi", "api", "CI", "Ci.cD", "ci/cd", "hİstorİa", "hıstorıa de usuarıo", "ſprint", "SPRINT", "K", "JIRA", "vamos a", "lo que voy a hacer", "h. d. u.", "HU-7", "add", "</b>", "x", ""]
    frame = spark.createDataFrame([(t,) for t in samples], "t string")
    patterns = [p for _, p in rules.TOPICS] + [rules.INTENT] + [p for p, _ in rules.VALUE_CUES] + [p for t in rules.THEMES for p in t[4]] + [p for _, ps in (*rules.ARTIFACT_SIGNALS, *rules.ACTIONS) for p in ps]
    guarded = [rules.matches(F.col("t"), p, rules.folded(F.col("t"))).alias(f"g{i}") for i, p in enumerate(patterns)]
    plain = [rules.matches(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(patterns)]
    for row in frame.select("t", *guarded, *plain).collect():
        assert [row[f"g{i}"] for i in range(len(patterns))] == [row[f"p{i}"] for i in range(len(patterns))], row["t"]


def test_needed_literals():
    assert rules.needed(r"\bf[oó]rmulas?\b") == ("rmula",) and rules.needed(r"a+|\d") == () and rules.needed(r"https?://") == ("http",)
    assert rules.needed(r"\b(?:uno|dos)\b") == ("uno", "dos")
