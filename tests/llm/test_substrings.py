import hashlib
import random

import pytest

from accountlens.llm import substrings


def plain(docs, span):
    """Sorted (doc_id, words, removed, kept) by the rule itself."""
    first = {}
    split = [(doc, (text or "").encode().split()) for doc, text in docs]
    for doc, words in split:
        for i in range(len(words) - span + 1 if doc is not None else 0):
            window = tuple(words[i : i + span])
            first[window] = min(first.get(window, doc), doc)
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - span + 1 if doc is not None else 0):
            if first[tuple(words[i : i + span])] < doc:
                gone.update(range(i, i + span))
        kept = [word for i, word in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def got(spark, docs, span, anchor):
    rows = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"), span, anchor).collect()
    return sorted((tuple(row) for row in rows), key=repr)


def test_documents(spark, sf_dir, texts):
    rows = substrings.op2_debruijn_dedup(spark, sf_dir).collect()
    want = {doc: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for doc, n, gone, kept in plain(texts.items(), 50)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(want)
    assert sum(r.n_removed for r in rows)


@pytest.mark.parametrize(("span", "anchor", "seed"), [(8, 3, 1), (6, 6, 2), (10, 2, 3)])
def test_dense_repeats(spark, span, anchor, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefg") for _ in range(rng.randrange(1, 40))] for _ in range(8)]
    docs = []
    for _ in range(80):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.7 else [rng.choice("abcdefg") for _ in range(rng.randrange(12))]
        docs.append((rng.choice([None, *range(60)]), " ".join(words)))
    docs += [(5, None), (None, None), (7, ""), (90, "a " * 100), (91, "a " * 30), (91, "a " * 30), (92, "a b " * 40)]
    assert got(spark, docs, span, anchor) == plain(docs, span)


def test_odd_rows(odd, none):
    rows = substrings.dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {row.doc_id: row for row in rows}
    assert by[5].n_removed == 0 and by[6].n_removed == by[6].n_words == 60_000 and by[6].kept == ""
    assert substrings.dedup(none).collect() == []


def test_a_repeated_row_is_the_source_at_branches(spark):
    """Its windows count once: a path is as long as its text says, and a copy under a larger id loses every word."""
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, a, b = new(30), new(15), new(15)
    whole = " ".join(a + passage + b)
    docs = [(1, whole), (1, whole), (2, " ".join(new(12) + passage + new(12))), (3, whole), (4, " ".join(passage)), (5, whole + " " + " ".join(new(9)))]
    assert got(spark, docs, 8, 3) == plain(docs, 8)
