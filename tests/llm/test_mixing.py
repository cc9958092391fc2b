"""Mixing against a plain water-filling, and what the mix holds."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from accountlens.llm import mixing


def filled(sizes, weights, epochs, total):
    """Targets by rounds of clamping, as fractions."""
    got, left, open_ = {}, Fraction(total), set(sizes)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight >= epochs * sizes[s]}
        if not over:
            return got | {s: left * weights[s] / weight for s in open_}
        for s in over:
            got[s] = Fraction(epochs * sizes[s])
        open_ -= over
        left = total - sum(got.values())
    return got


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_plain_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": int(rng.lognormvariate(6, 2)) for i in range(40)} | {"none": 0}
    weights = {s: rng.randint(1, 50) for s in sizes}
    sources = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight long")
    for epochs, total in ((3, None), (1, sum(sizes.values()) // 2), (2, 5 * sum(sizes.values()))):
        want = filled(sizes, weights, epochs, sum(sizes.values()) if total is None else total)
        got = {r.source: r.target for r in mixing.targets(sources, epochs, total).collect()}
        assert got == {s: pytest.approx(float(t)) for s, t in want.items()}


def test_each_source_meets_its_target(spark, sf_dir):
    rows = mixing.op11_source_mixing(spark, sf_dir).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.copies * r.size <= r.taken <= min(3, r.copies + 1) * r.size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    again = mixing.op11_source_mixing(spark, sf_dir).collect()
    assert Counter(rows) == Counter(again)


def test_another_seed_takes_others(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('w', id, ' x y') AS text", "'a' AS source")
    plan = spark.createDataFrame([("a", 1200, 1)], "source string, source_size long, weight long")
    taken = {seed: {r.doc_id for r in mixing.mix(mixing.sized(docs, seed), plan, total=600).collect() if r.taken} for seed in (1, 2)}
    assert len(taken[1]) == len(taken[2]) == 200 and taken[1] != taken[2]


def test_repetitions_hold_the_words_taken(spark):
    texts = {"a": "one two\tthree", "b": " four  five six seven", "c": "eight"}
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(sorted(texts.items()))], "doc_id long, text string, source string")
    documents = mixing.sized(docs, keep=("text",))
    plan = spark.createDataFrame([("a", 3, 2), ("b", 4, 2), ("c", 1, 5)], "source string, source_size long, weight long")
    mixed = mixing.mix(documents, plan, total=11)
    words = defaultdict(list)
    for r in mixing.repetitions(mixed).collect():
        words[r.source] += r.text.split()
        assert texts[r.source].strip().startswith(r.text.strip())
    # c is clamped to 3 words; 8 are left for a and b.
    assert Counter(words["c"]) == {"eight": 3}
    assert Counter(words["a"]) == {"one": 2, "two": 1, "three": 1} and Counter(words["b"]) == Counter(texts["b"].split())


def test_odd_rows(odd, none):
    def run(docs):
        documents = mixing.sized(docs)
        sources = mixing.cycled(documents.groupBy("source").sum("size").withColumnRenamed("sum(size)", "source_size"))
        return sources.collect(), mixing.mix(documents, sources).collect()

    sources, rows = run(odd)
    assert {r.source: r.weight for r in sources} == {"a": 1, "b": 2, "c": 3, None: 1}
    assert len(rows) == 12 and all(r.taken == 0 for r in rows if r.size == 0)
    by = {r.source: (r.source_size, r.target) for r in rows}
    assert by[None] == (0, 0) and by["a"][1] == 3 * by["a"][0] and by["c"][1] == 3 * by["c"][0]
    assert sum(r.taken for r in rows if r.source == "b") == by["b"][1]
    assert run(none) == ([], [])
