"""Collocations against a plain count, and the parse against all n-grams."""

import re
from collections import Counter, defaultdict

import pytest

from accountlens.llm import collocations as C
from accountlens.llm.common import staged

UPPER = {i: i + 32 for i in range(65, 91)}


def plain(rows, longest=3):
    """(lang, text) pairs to counts of phrases by language."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {lang: c for lang, c in counts.items() if c}


def expected(rows, longest=3, least=10, share=50, top=2000):
    out = []
    for lang, f in plain(rows, longest).items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        several = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {
            p[i : i + m] for p, a in several.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
            if 100 * a >= share * f[p[i : i + m]]
        }
        scored = []
        for p, a in several.items():
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if p not in dropped:
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total, -score))
    return Counter(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def found(docs, longest=3, least=10, every=C.EVERY, **more):
    slices = staged(C.dealt(C.parse(docs, longest, every), longest), "chunks")
    counted = staged(C.frequencies(slices, longest, least), "phrases")
    return Counter(tuple(r) for r in C.collocations(counted, **more).select(COLUMNS).collect())


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = Counter(tuple(r) for r in C.op13_phrase_collocations(spark, sf_dir).select(COLUMNS).collect())
    assert got == expected(rows) and got


@pytest.mark.parametrize(("longest", "every"), [(2, 1), (2, 5), (3, 1), (3, 4), (4, 3), (5, 2)])
def test_many_cuts_and_slices_change_no_count(spark, sf_dir, monkeypatch, longest, every):
    monkeypatch.setattr(C, "BUCKET", 20_000)
    monkeypatch.setattr(C, "GATHERED", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    slices = staged(C.dealt(C.parse(docs, longest, every), longest), "chunks")
    got = {(r.lang, r.phrase): (r.words, r.n) for r in C.frequencies(slices, longest, 2).collect()}
    want = {}
    for lang, f in plain(rows, longest).items():
        want |= {(lang, " ".join(p)): (len(p), n) for p, n in f.items() if n >= 2}
        want[lang, None] = (0, sum(n for p, n in f.items() if len(p) == 1))
    assert got == want


def test_equal_passages_give_equal_chunks(spark):
    passage = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    docs = spark.createDataFrame([("en", f"{'x ' * i}{passage} {'y ' * i}") for i in range(20)], "lang string, text string")
    rows = C.parse(docs).collect()
    shared = [r for r in rows if r.times == 20]
    assert sum(len(r.chunk) for r in shared) > 0.7 * len(passage) and len(rows) < 20 * 5 + len(shared)


def test_options(spark):
    rows = [("en", "new york city. New York city, old york; a b c d")] * 12 + [("en", "york city")] * 30 + [(None, "a b  c\td")] * 15
    docs = spark.createDataFrame(rows, "lang string, text string")
    for longest, least, share, top in ((3, 10, 50, 2000), (4, 12, 50, 3), (2, 24, 1, 5), (3, 10, 100, 2)):
        assert found(docs, longest, least, share=share, top=top) == expected(rows, longest, least, share, top)


def test_runs_without_cuts_and_large_counts(spark):
    rows = [("en", "a " * 30_000), ("en", "b\n" * 3000), ("de", "Ä Ö " * 9000), ("de", "x")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs) == expected(rows)
    counted = spark.createDataFrame(
        [("en", None, 0, 10**15)] + [("en", p, w, n) for p, w, n in (("p", 1, 10**14), ("q", 1, 3 * 10**14 - 1), ("p q", 2, 10**14 - 7))],
        "lang string, phrase string, words int, n long",
    )
    (row,) = C.collocations(counted).collect()
    assert row.score == 10**6 * (10**14 - 7) ** 2 // (10**14 * (3 * 10**14 - 1))


def test_odd_rows(odd, none):
    assert found(odd) == expected([(r.lang, r.text) for r in odd.collect()]) != Counter()
    assert found(none) == Counter()
