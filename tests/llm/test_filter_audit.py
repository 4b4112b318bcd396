"""The filter audit against a walk through every order."""

import itertools
import random
import re

from chronolith.llm import filter_audit


def brute(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    rows = [(d, t or "", p or "") for d, t, p in rows]
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    flags = []
    for d, t, p in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d,
        }
        flags.append((p, d, {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for p, *_ in flags}:
        own = [(d, f) for p, d, f in flags if p == part]
        shares = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[f] += len(gone)
                fails = [x for x in own if f in x[1]]
                found[order, step] = [len(left), len(gone), len(fails) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (order, step), v in found.items():
            out[part, order, step] = (*v, shares[order[step - 1]])
    return out


def test_audit_equals_every_order(spark):
    rng = random.Random(13)
    words = ["one", "Two", "three", "FOUR", "#five", "six|", "sieben\u0085acht", "é\x1cñ", "日本"]
    texts = [None, "", " ", "A", "#" * 3, *[" ".join(rng.choice(words + [f"w{i}" for i in range(rng.choice([5, 200]))]) for _ in range(rng.randint(1, 120))) for _ in range(40)], "Ab " * 4000]
    rows = [(rng.choice([None, rng.randrange(300)]) if k % 9 == 0 else k, rng.choice(texts), rng.choice(["src1", "src2", None, ""])) for k in range(260)]
    rows += rows[:20]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (6, 0, 0)]
    some = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, SOURCE int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(some, marks).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    want = brute(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == want and len(got) == len(want) == 3 * 600
    assert filter_audit.filter_audit(some.where("false"), marks).count() == 0
    assert filter_audit.filter_audit(some, marks.where("false")).where("good_lost > 0 or toxic_lost > 0").count() == 0
