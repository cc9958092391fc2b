import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from accountlens.llm import simhash


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    values = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(fps, distance):
    """Index to the least index reachable."""
    root = list(range(len(fps)))
    changed = True
    values = np.array(fps, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(values ^ value) <= distance) for value in values]
    while changed:
        changed = False
        for i, others in enumerate(near):
            least = min(root[j] for j in others)
            if least < root[i]:
                root[i], changed = least, True
    return root


def test_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash_dedup(spark, sf_dir).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    root = plain_components(fps, 4)
    assert got == {d: (f"{fp:016x}", ids[r]) for d, fp, r in zip(ids, fps, root, strict=True)}


def test_spark_has_the_same_hash(spark):
    for text in ("", "a b c d", "Ünïcödé x" * 20):
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize(("distance", "pieces"), [(4, 3), (4, 2), (3, 4), (5, 3)])
def test_links_connect_what_near_pairs_connect(spark, distance, pieces, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(distance * 10 + pieces)
    fps = []
    for _ in range(12):  # dense groups, chains among them
        centre = rng.getrandbits(64)
        for _ in range(20):
            fps.append(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}))
    fps = sorted({fp - 2**64 if fp >= 2**63 else fp for fp in fps})
    links = simhash.links(spark.createDataFrame([(fp,) for fp in fps], "fp long"), distance, pieces)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    want = plain_components([fp % 2**64 for fp in fps], distance)
    assert [roots.get(fp, fp) for fp in fps] == [fps[r] for r in want]


def test_a_dense_group_makes_few_links(spark):
    fps = [(1 << a) | (1 << b) for a in range(64) for b in range(a)]
    links = simhash.links(spark.createDataFrame([(fp - 2**64 if fp >= 2**63 else fp,) for fp in fps], "fp long"), 4)
    assert links.count() < 60 * len(fps)  # of about two million near pairs


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, 4, 4).collect()
    assert len(rows) == odd.count()
    by = {}
    for row in rows:
        by.setdefault(row.doc_id, []).append((row.fp, row.component_id))
    assert by[1] == by[2] == by[3] == [(0, 1)]
    assert by[5] == [by[6][0]] == [by[6][1]] and by[5][0][1] == 5
    assert sorted(c for _, c in by[None]) == [1, 5]
    assert simhash.near_duplicates(none, 4, 4).collect() == []
    lone = odd.where("doc_id is null and text is null")
    assert [tuple(r) for r in simhash.near_duplicates(lone, 4, 4).collect()] == [(None, 0, None)]
