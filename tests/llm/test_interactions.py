import itertools
import re

from folioscope.llm import interactions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order applied document by document."""
    text = lambda r: r[1] or ""
    first = {}
    for r in docs:
        if r[0] is not None:
            first[text(r)] = min(first.get(text(r), r[0]), r[0])
    good, toxic = ({d for d, *marks in labels if marks[i] == 1 and d is not None} for i in (0, 1))
    fails = []
    for r in docs:
        t, w = text(r), WORD.findall(text(r))
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and first[t] < r[0]}
        fails.append((r[2] or "", f, r[0] in good, r[0] in toxic))
    out = set()
    for part in {x[0] for x in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone, left = [x for x in left if x[0][name]], [x for x in left if not x[0][name]]
                total[name] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(x[0][name] for x in own) - len(gone), sum(x[0][name] and sum(x[0].values()) == 1 for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out |= {(*r, total[r[1][r[2] - 1]]) for r in rows}
    return out


def made():
    plain = " ".join(f"word{i} é" if i % 9 == 0 else f"word{i}" for i in range(60))
    texts = [plain, plain, plain + " $", "A B C", None, "", "  \n", "x " * 80, "Caps " * 10, plain.upper(), "long " + " ".join(str(i) for i in range(60_000)), plain, "#", "A B C", "A B"]
    docs = [(i, t, ("s", None, "", "t")[i % 4]) for i, t in enumerate(texts)]
    docs += [(0, plain, "s"), (None, plain, "s"), (None, None, None), (20, plain, "s"), (20, plain, "t"), (20, "A B C", "t")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, None), (3, None, 1), (4, 0, 1), (None, 1, 1), (20, 1, 0), (8, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "'x' AS part", "2 AS good").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_same_as_brute_force(spark):
    docs, labels = made()
    got = interactions.audit(spark, *frames(spark, docs, labels)).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 600 * 3
    assert {tuple(r) for r in got} == want


def test_sums_are_given_out_when_there_are_many_parts(spark, monkeypatch):
    docs = [(i, f"text {i % 7}", f"part {i}") for i in range(9)]
    monkeypatch.setattr(interactions, "HELD", 2)
    got = interactions.audit(spark, *frames(spark, docs, [])).collect()
    assert {tuple(r) for r in got} == brute(docs, [])


def test_empty_tables(spark):
    docs, labels = frames(spark, [], [])
    assert interactions.audit(spark, docs, labels).count() == 0


def test_table_of_first_failures():
    assert interactions.FIRST.shape == (32, 120) and (interactions.FIRST[0] == 5).all()
    at = interactions.NAMES.index("EDCBA")
    assert interactions.FIRST[0b00001, at] == 4 and interactions.FIRST[0b10001, at] == 0
