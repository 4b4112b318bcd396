"""Matches that blocking by words of names once lost."""

import random
from difflib import SequenceMatcher

import pytest

from chronolith.operators import entities

FIELDS = "name string, objective string, actor string, flow string, trigger string, functionalities array<string>"


def test_every_candidate_meets_the_whole_store(spark):
    rest = ("emitir el documento", "cajero", "abrir y emitir", "venta")
    names = ["Factura", "Alta", "发票", "ab"]
    stored = ["Facturas", "Baja total", "发票单", "cd", "zz"]
    cand = spark.createDataFrame([(n, n, *rest, []) for n in names], f"cand_id string, {FIELDS}")
    store = spark.createDataFrame([(s, i, s, *rest, []) for i, s in enumerate(stored)], f"use_case_id string, ord int, {FIELDS}")
    got = {r["cand_id"]: r for r in entities.match_use_cases(cand, store).collect()}
    for n in names:
        score, _, best = max((0.35 * SequenceMatcher(None, n.lower(), s.lower()).ratio() + 0.65, -i, s) for i, s in enumerate(stored))
        assert abs(got[n]["score"] - score) < 1e-9
        assert got[n]["status"] != "NEW" and got[n]["use_case_id"] == best
    assert got["Factura"]["status"] == "DUPLICATE"


@pytest.mark.parametrize("few", [99, 0])
def test_tiles_find_the_best_of_all_pairs(spark, monkeypatch, few):
    """Over several tiles, met all or by their bounds, with nulls, blanks, ties, repeated rows and long texts, against every
    pair scored by itself."""
    monkeypatch.setattr(entities, "FEW_TILES", few)
    monkeypatch.setattr(entities, "SUM_BLOCK", 3)
    monkeypatch.setattr(entities, "TILE", 7)
    monkeypatch.setattr(entities, "STORE_TILE", 9)
    rng = random.Random(11)
    words = ["alta", "baja", "cliente", "factura", "emitir", "pago", "CAJA", "é"]
    some = lambda n: rng.choice([None, "", "  ", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, n))) for _ in range(4)]])
    row = lambda k: (k, *(some(n) for n in (4, 60, 3, 8, 4)), rng.choice([None, [], ["F1"], ["F1", "F2", None]]))
    cands, stored = [row(f"c{i}") for i in range(40)], [row(f"u{i}") for i in range(60)]
    stored += [(f"v{i}", *r[1:]) for i, r in enumerate(stored[:15])]

    def likeness(c, e):
        total = weights = 0.0
        for (_, w), a, b in zip(entities.FIELD_WEIGHTS, c[1:6], e[1:6], strict=True):
            a, b = a or "", b or ""
            if a or b:
                x, y = a.strip().lower(), b.strip().lower()
                total, weights = total + w * (SequenceMatcher(None, x, y).ratio() if x and y else 0.0), weights + w
        if {x for x in c[6] or () if x} & {x for x in e[6] or () if x}:
            total, weights = total + 0.05, weights + 0.05
        return total / weights if weights else 0.0

    cand = spark.createDataFrame(cands, f"cand_id string, {FIELDS}")
    store = spark.createDataFrame([(k, i, *r) for i, (k, *r) in enumerate(stored)], f"use_case_id string, ord int, {FIELDS}")
    got = {r["cand_id"]: (r["use_case_id"], r["score"]) for r in entities.match_use_cases(cand, store).collect()}
    assert len(got) == len(cands)
    for c in cands:
        score, at = max((likeness(c, e), -i) for i, e in enumerate(stored))
        assert abs(got[c[0]][1] - score) < 1e-12
        assert got[c[0]][0] == (stored[-at][0] if score >= entities.RELATED else None)
    assert {r["status"] for r in entities.match_use_cases(cand, store.limit(0)).collect()} == {"NEW"}
    assert entities.match_use_cases(cand.limit(0), store).count() == 0


def test_tiles_that_cannot_win_are_not_met(spark, monkeypatch):
    """Texts of several alphabets and lengths: near copies are found, and most of the store is never compared."""
    monkeypatch.setattr(entities, "STORE_TILE", 20)
    rng = random.Random(5)
    alphabets = ["abcdefgh", "ijklmnop", "qrstuvwx", "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437"]

    def text(i):
        return "".join(rng.choice(alphabets[i % 4] + " ") for _ in range(20 + 15 * (i % 7)))

    stored = [(f"u{i:03d}", i, text(i), text(i), "", "", "", []) for i in range(400)]
    changed = lambda t: t[:9] + "#" + t[10:]
    cands = [(k, changed(name), changed(objective), *rest) for k, _, name, objective, *rest in stored[::5]]
    store = spark.createDataFrame(stored, f"use_case_id string, ord int, {FIELDS}")
    got = entities.match_use_cases(spark.createDataFrame(cands, f"cand_id string, {FIELDS}"), store, with_met=True).collect()
    assert len(got) == 80 and all(r["use_case_id"] == r["cand_id"] and r["status"] == "DUPLICATE" for r in got)
    assert sum(r["met"] for r in got) < 0.05 * len(stored) * len(cands)
