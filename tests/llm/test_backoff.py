import math
import zlib
from collections import Counter

import numpy as np
import pytest

from accountlens.llm import backoff


class Plain:
    """The same model word by word."""

    def __init__(self, training):
        self.count, pairs = Counter(), Counter()
        for tokens in training:
            self.count.update(tokens)
            pairs.update(zip([b"", *tokens], tokens, strict=False))
        self.total, self.distinct = sum(self.count.values()), len(self.count)
        self.state, self.arcs = set(self.count), pairs
        self.taken = Counter()
        for (state, _), n in self.arcs.items():
            self.taken[state] += n - backoff.DISCOUNT

    def own(self, word):
        return (self.count[word] + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def p(self, state, word):
        if state not in self.state:
            return self.own(word)
        arc = self.arcs.get((state, word))
        return (1 - self.taken[state] / self.count[state]) * self.own(word) + (arc - backoff.DISCOUNT if arc else 0) / self.count[state]


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def check(rows, texts, model):
    for row in rows:
        own = tokens(texts[row.doc_id])
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(model.count[x] > 0 for x in own), model.total)
        assert row.base_score == pytest.approx(sum(math.log10(model.own(x)) for x in own))
        assert row.score == pytest.approx(sum(math.log10(model.p(a, b)) for a, b in zip([b"", *own], own, strict=False)))


def test_against_brute_force(spark, sf_dir, texts):
    rows = backoff.op5_backoff_lm(spark, sf_dir).collect()
    held_out = {doc: zlib.crc32(str(doc).encode()) % 5 == 1 for doc in texts}
    model = Plain(tokens(text) for doc, text in texts.items() if not held_out[doc])
    for state in (b"the", b"", b"de"):
        assert sum(model.p(state, word) for word in model.count) + model.p(state, b"no such word") == pytest.approx(1)
    assert {row.doc_id: row.held_out for row in rows} == held_out
    check(rows, texts, model)
    unseen = [row for row in rows if row.held_out]
    assert sum(row.score for row in unseen) > sum(row.base_score for row in unseen)


def test_failure_arcs_are_followed():
    """Word 1 has an arc to 2 only; 3 is reached over the empty state."""
    arcs = np.array([-0.25, np.nan, np.nan])  # 1 to 2, 2 to 3, 1 to 3
    automaton = backoff.Automaton(arcs, np.array([0, -1.0, -2.0, -4.0]), np.array([-8.0, -16.0, -32.0, -64.0]))
    assert automaton.read(1, [2, 3], [0, 1]) == -0.25 + (-2.0 - 64.0)
    assert automaton.read(1, [3], [2]) == -1.0 - 64.0
    assert automaton.read(1, [], []) == 0


def test_odd_rows(odd, none):
    rows = backoff.score(odd, odd).collect()
    assert len(rows) == odd.count()
    assert [row.n_tokens for row in rows if row.doc_id in (1, 2, 3)] == [1, 1, 1]
    twins = {(row.n_tokens, row.n_known, row.base_score, row.score) for row in rows if row.doc_id == 6}
    assert len(twins) == 1
    assert backoff.score(none, odd).collect() == []
    unknown = backoff.score(odd, none).collect()
    assert all(row.n_known == 0 and row.train_tokens == 0 for row in unknown)
    assert all(row.base_score == pytest.approx(0, abs=1e-6) and row.score == pytest.approx(0, abs=1e-6) for row in unknown)


def test_no_bound_on_states_and_arcs(spark):
    """A bigram seen once is an arc, and the model's bounds don't move with the size of the training texts."""
    docs = spark.createDataFrame([(1, "red kite"), (2, "kite red"), (3, None)], "doc_id long, text string")
    training = ["red kite", "blue kite", "red sky at night", ""]
    rows = {row.doc_id: row.score for row in backoff.score(docs, spark.createDataFrame([(x,) for x in training], "text string")).collect()}
    counts, pairs = Counter(), Counter()
    for text in training:
        own = tokens(text)
        counts.update(own)
        pairs.update(zip([b"", *own], own, strict=False))
    total, kinds = sum(counts.values()), len(counts)

    def p(state, word):
        own = (counts[word] + 0.5) / (total + 0.5 * (kinds + 1))
        arcs = sum(pair[0] == state for pair in pairs)
        return (max(pairs[state, word] - 0.75, 0) + 0.75 * arcs * own) / counts[state]

    for doc, text in ((1, "red kite"), (2, "kite red"), (3, "")):
        own = tokens(text)
        assert rows[doc] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([b"", *own], own, strict=False)))
