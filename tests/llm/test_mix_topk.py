import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptforge.llm import bit_sliced, cube_mix
from tests.llm.helpers import AWKWARD, DOC, docs, rows_of


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    total = defaultdict(int)
    for source, size in sizes:
        total[source] += size
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in order}, set(order)
    left = share * sum(total.values())
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += unit * weight[s]
            if target[s] >= most * total[s]:
                left += target[s] - most * total[s]
                target[s] = most * total[s]
                open_.discard(s)
    return total, target


def mixed_rows(seed, n, sources):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * int(rnd.paretovariate(0.8) * 20) if rnd.random() < 0.97 else []), None,
             rnd.choice(sources)) for i in range(n)]


def test_mix_targets_and_totals(spark):
    rows = mixed_rows(1, 3000, ["a"] * 6 + ["b", "c", "d", "é", "Z", None])
    got = cube_mix.mix(docs(spark, rows), block_rows=200).collect()
    source = {i: s for i, _, _, s in rows}
    size = {i: len(t.split()) for i, t, _, _ in rows}
    total, target = brute_targets([(s, size[i]) for i, s in source.items()])
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(source)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in total:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s] / 2)


def test_mix_reruns_agree(spark):
    table = docs(spark, mixed_rows(2, 800, ["a", "b", None]))
    assert rows_of(cube_mix.mix(table, block_rows=100)) == rows_of(cube_mix.mix(table, block_rows=100))


def test_mix_balances_documents_too(spark):
    rows = mixed_rows(3, 4000, ["a", "b"])
    got = cube_mix.mix(docs(spark, rows), block_rows=500).collect()
    for name in ("a", "b"):
        mine = [r for r in got if rows[r.doc_id][3] == name]
        times = sum(r.times for r in mine)
        want = len(mine) * mine[0].target / mine[0].source_size
        assert abs(times - want) <= 10


def test_flight_keeps_totals():
    rnd = random.Random(7)
    units = [(i, rnd.random(), rnd.choice([3, 3, 5, 100, 0])) for i in range(500)]
    flight, out = cube_mix.Flight("s"), []
    for u in units:
        out += flight.add(*u)
    out += flight.rest()
    assert sorted(k for k, _, _ in out) == list(range(500))
    assert math.isclose(sum(p for _, p, _ in out), sum(p for _, p, _ in units), abs_tol=1e-6)
    assert math.isclose(sum(p * s for _, p, s in out), sum(p * s for _, p, s in units), abs_tol=1e-4)
    assert sum(0 < p < 1 for _, p, _ in out) <= 2


def test_mix_awkward_rows(spark):
    table = docs(spark, AWKWARD)
    got = cube_mix.mix(table).collect()
    assert len(got) == len(AWKWARD)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    _, target = brute_targets([(s, words(t)) for _, t, _, s in AWKWARD])
    assert sorted(r.size for r in got) == sorted(words(t) for _, t, _, _ in AWKWARD)
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    out = cube_mix.mixed_documents(table)
    assert out.columns == table.columns
    taken = sum(r.times for r in got)
    assert abs(out.count() - taken) <= 4  # repeated rows share what they are taken
    assert cube_mix.mix(spark.createDataFrame([], DOC)).count() == 0
    assert cube_mix.mixed_documents(spark.createDataFrame([], DOC)).count() == 0


def brute_top(vectors, k, step, scale=256):
    fine = {(i, tuple(v)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    rows = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in fine]
    out = []
    for i, q in rows:
        if i is None or i % step:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j) for j, v in rows if j != i and len(v) == len(q)),
                        key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


VEC = "vec_id long, embedding array<float>, score string, rank int"


def test_top_k_brute_force(spark):
    rnd = random.Random(11)
    vectors = [(i, [rnd.choice([rnd.gauss(0, 0.3), 0.0, 0.25, -0.25]) for _ in range(7)]) for i in range(400)]
    vectors += [(400 + i, vectors[i][1]) for i in range(40)]  # ties
    df = spark.createDataFrame([(*v, "s", 1) for v in vectors], VEC)
    for shard_rows, query_rows in ((64, 5), (16384, 512)):
        got = rows_of(bit_sliced.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, query_rows=query_rows))
        assert got == brute_top(vectors, 5, 10)


def test_top_k_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, -1.0]), (1, [1.0, -1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (50, [0.5, 0.5]),
               (6, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (7, []), (150, []), (8, [0.0, -0.0]), (None, [3.0, 3.0]), (None, [3.0, 3.0]),
               (9, [-5.0, 7.0]), (9, [-5.0, 7.0]), (200, [9.0])]
    df = spark.createDataFrame([(*v, "s", 1) for v in vectors], VEC)
    assert rows_of(bit_sliced.top_k(df, F.col("vec_id") % 50 == 0)) == brute_top(vectors, 5, 50)
    assert bit_sliced.top_k(spark.createDataFrame([], VEC), F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e9], "s", 1), (1, [1.0], "s", 1)], VEC)
    with pytest.raises(Exception, match="2\\^27"):
        bit_sliced.top_k(big, F.col("vec_id") % 50 == 0).collect()


def test_mixed_documents_with_clashing_names_and_repeated_rows(spark):
    names = {"fp": "_id", "size": "_copy", "kept": "_text_key", "lang": "_times"}
    rows = mixed_rows(7, 200, ["a", "b"]) + [(5000, "one two three", "l" if i % 2 else "m", "a") for i in range(9)] + \
        [(None, "four five", None, "b")] * 3
    table = docs(spark, rows).withColumnsRenamed(names)
    out = cube_mix.mixed_documents(table.repartition(5)).cache()
    assert out.columns == table.columns and {(r._id, r._copy, r._text_key) for r in out.collect()} == {("x", "y", "z")}
    taken = {(r.doc_id, r.key): r for r in cube_mix.mix(table).groupBy("doc_id", "key").agg(F.sum("times").alias("n")).collect()}
    got = out.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.count("*").alias("n")).collect()
    assert {(r.doc_id, r.key): r.n for r in got} == {k: r.n for k, r in taken.items() if r.n}
    copies = {r._times: r["count"] for r in out.where("doc_id = 5000").groupBy("_times").count().collect()}
    each = sum(copies.values()) // 9  # four rows of one kind and five of the other share evenly
    assert all(n * each <= copies.get(kind, 0) <= n * (each + 1) for kind, n in (("l", 4), ("m", 5)))
    again = cube_mix.mixed_documents(table.repartition(3))
    assert rows_of(again) == rows_of(out)
