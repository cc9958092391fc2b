import random

import numpy as np
import pyarrow as pa

from accountlens.llm import topk


def plain(vectors, queries, k):
    known = {(i, c) for i, c in vectors if i is not None and c is not None}
    out = set()
    for query, code in {(i, c) for i, c in queries if i is not None and c is not None}:
        near = sorted({(bin((code ^ c) % 2**64).count("1"), i) for i, c in known if i != query})[:k]
        out |= {(query, place, i, apart) for place, (apart, i) in enumerate(near, 1)}
    return out


def got(spark, vectors, queries, k):
    frames = [spark.createDataFrame(rows, "vec_id long, code long") for rows in (vectors, queries)]
    return {tuple(row) for row in topk.top_k(*frames, k).collect()}


def test_hot_codes_and_ties(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(63) for _ in range(5)]
    vectors = [(i, rng.choice(centres) ^ (1 << rng.randrange(63)) * rng.randrange(2)) for i in range(300)]
    vectors += [(1000 + i, centres[0]) for i in range(200)] + [(None, 1), (2000, None), (7, vectors[7][1]), (3000, -1)]
    queries = vectors[::9] + [(2000, None), (None, 4), (5000, centres[1])]
    assert got(spark, vectors, queries, 10) == plain(vectors, queries, 10)


def test_few_rows(spark):
    vectors = [(1, 0), (2, -1), (3, 255)]
    assert got(spark, vectors, vectors, 5) == plain(vectors, vectors, 5)
    assert got(spark, [], [(1, 5)], 3) == set() and got(spark, [(1, 5)], [], 3) == set() and got(spark, [(1, 5)], [(1, 5)], 3) == set()


def test_sign_code(spark):
    rows = [([1.0, -1.0, 0.0, None, 2.0],), ([],), ([1.0] * 70,)]
    codes = [row[0] for row in spark.createDataFrame(rows, "v array<float>").select(topk.sign_code("v")).collect()]
    assert codes == [0b10001, 0, -1]


def test_columns_with_clashing_names(spark):
    rows = [(i, i * 37 % 64) for i in range(40)]
    names = ["segment", "slot", "place", "query", "Code2", "distance", "rank", "apart", "key"]
    frames = [spark.createDataFrame([(*row, *names) for row in own], "vec_id long, code long, " + ", ".join(f"{n} string" for n in names)) for own in (rows, rows[:5])]
    assert {tuple(row) for row in topk.top_k(*frames, 4).collect()} == plain(rows, rows[:5], 4)


def test_lookups_far_off_are_not_shuffled(spark, monkeypatch):
    """Groups in shares, verified in small steps; of what lies behind the k-th nothing leaves a task."""
    monkeypatch.setattr(topk, "GROUP_CODES", 60)
    monkeypatch.setattr(topk, "STEP", 500)
    rng = random.Random(2)
    centres = [rng.getrandbits(63) for _ in range(60)]
    vectors = [(i, rng.choice(centres) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(2000)] + [(9000 + i, -1) for i in range(20)]
    queries = vectors[::150] + [(9500, -2)]
    assert got(spark, vectors, queries, 10) == plain(vectors, queries, 10)


def test_a_task_gives_the_best_within_the_bound():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << (topk.WIDTH - topk.FRONT), 4000) | (rng.integers(-(2**31), 2**31, 4000) << 32)
    entries = pa.table({"code": codes, "least": np.arange(4000), "n": np.ones(4000, np.int32)})
    asked = pa.table({"query": codes[:50] ^ 1, "bound": np.full(50, 12, np.int32), "segment": np.zeros(50, np.int32), "front": np.zeros(50, np.int32)})
    out = topk._lookups(2, 5)(entries, asked)
    found = set(zip(*(out[c].to_pylist() for c in ("query", "apart", "least")), strict=True))
    wanted = set()
    for q in (codes[:50] ^ 1).tolist():
        apart = [(((q ^ c) % 2**64).bit_count(), i) for i, c in enumerate(codes.tolist()) if ((q ^ c) & 0xFFFF).bit_count() == 2]
        wanted |= {(q, d, i) for d, i in sorted(x for x in apart if x[0] <= 12)[:5]}
    assert found == wanted and len(wanted) < 50 * 5
