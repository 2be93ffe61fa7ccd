"""Delta rounds against plain rounds in whole numbers."""

import hashlib
import random
from fractions import Fraction

import pytest

from strataflow.llm import lloyd
from tests.llm.util import frame

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, row string"


def plainly(rows):
    kept = [(i, [int(Fraction(x) * 1024 // 1) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and x == x and abs(x) < float("inf") for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:8]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(10):
        owners = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, o) in zip(kept, owners, strict=True) if o == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    owners = [(min(d, lloyd.LARGEST), j) for d, j in assign()]
    inertia = [min(sum(d for d, o in owners if o == j), lloyd.LARGEST) for j in range(len(centroids))]
    total = min(sum(d for d, _ in owners), lloyd.LARGEST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], total, sha[j]) for (i, _), (d, j) in zip(kept, owners, strict=True)), key=str)


def rows(n, seed=1, odd=True):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    made = [(i, [x + r.gauss(0, 0.4) for x in r.choice(middle)], 1, "clash", "clash") for i in range(n)]
    if odd:
        v = made[0][1]
        made += [(900, None, 1, "", ""), (901, v[:63], 1, "", ""), (902, [*v, 1.0], 1, "", ""), (903, [None, *v[1:]], 1, "", ""), (904, [float("nan"), *v[1:]], 1, "", ""), (905, [*v[1:], float("-inf")], 1, "", ""), (906, [], 1, "", "")]
        made += [(None, [0.25] * 64, None, None, None), (3, v, 1, "", ""), *made[:5], *[(2000 + i, [0.5] * 64, 1, "", "") for i in range(150)], (910, [-0.0] * 64, 1, "", "")]
    return made


def got(spark, table):
    return sorted((tuple(x) for x in lloyd.query(spark, frame(spark, table, SCHEMA)).collect()), key=str)


def test_delta_rounds_are_plain_rounds(spark):
    assert got(spark, rows(300)) == plainly(rows(300))


@pytest.mark.parametrize("large", [4096.0, -1e9, 1e300])
def test_components_of_any_size(spark, large):
    table = [*rows(60, 2, False), (70, [large] * 64, 1, "", ""), (71, [large * 1.5] + [0.1] * 63, 1, "", ""), (72, [-large] * 64, 1, "", "")]
    assert got(spark, table) == plainly(table)


def test_few_and_none(spark):
    few = rows(3, 4, False)
    assert got(spark, few) == plainly(few)
    assert got(spark, [(1, [0.1] * 3, 1, "", "")]) == [] == plainly([(1, [0.1] * 3, 1, "", "")])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("vectors_", "assignments_"))]
