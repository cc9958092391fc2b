import zlib
from collections import Counter

import pytest

from accountlens.llm import langid


def plain_grams(text):
    """The n-grams of each word between two blanks, counted one by one."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded = [f" {word} " for word in words]
    return Counter(w[i : i + n] for w in padded for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")


def ranked(counts, size=langid.PROFILE):
    """The most frequent first; of one count the shorter first, then by code point."""
    return [gram for gram, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:size]


def plain_distance(own, profile, size):
    places = {gram: i for i, gram in enumerate(profile)}
    return sum(abs(places[gram] - i) if gram in places else size for i, gram in enumerate(own)) / len(own) / size


HARD = ["", None, "a", "ß ẞ", "İstanbul ÇA", "x1y²z", "²½Ⅷ①", "été\U0001d400 漢字 한국", "a" * 9, "don't; can't", "  the\nthe\tTHE "]


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_grams_equal_plain_ones(texts, monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    for text in [*HARD, *list(texts.values())[:20]]:
        codes, counts = langid.grams(text)
        assert dict(zip(map(langid.gram_text, codes.tolist()), counts.tolist(), strict=True)) == plain_grams(text)
        assert codes.tolist() == sorted(codes.tolist()) == [langid.gram_code(langid.gram_text(c)) for c in codes.tolist()]


def test_predictions_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    odd = [(10**6 + i, text, None) for i, text in enumerate(HARD)] + [(10**7, "zu Hause", "de"), (10**7 + 1, "x", None), (None, "le la", "fr")]
    rows = [tuple(r) for r in docs] + odd
    counts = {}
    for doc, text, lang in rows:
        if lang is not None and (doc is None or zlib.crc32(str(doc).encode()) % 3 != 1):
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))][: langid.PROFILE] for lang, c in counts.items()}
    want = {}
    for doc, text, _ in rows:
        own = ranked(plain_grams(text))
        best = min((plain_distance(own, profile, langid.PROFILE), lang) for lang, profile in profiles.items()) if own else (1, "und")
        want[doc] = (best[1], pytest.approx(1 - best[0]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == want


def test_profiles_count_every_training_text(spark, texts):
    rows = spark.createDataFrame([("en", "aa ab"), ("en", "ab"), ("fr", "zz"), (None, "qq"), ("en", None)], "lang string, text string")
    got = {(r.lang, r.gram): r.place for r in langid.profiles(rows).collect()}
    assert got["en", "a"] == 0  # four times
    assert ("fr", "zz") in got and not any(gram == "qq" for _, gram in got)


def test_distance_is_the_out_of_place_measure():
    profile = ranked(plain_grams("the and of"), 10)
    learned = [("en", gram, place) for place, gram in enumerate(profile)]
    own = ranked(plain_grams("the and xyz the"), 10)
    assert langid.Ranker(learned, 10).distances(*langid.grams("the and xyz the"))[0] == pytest.approx(plain_distance(own, profile, 10))


def test_held_out_accuracy(spark, sf_dir):
    rows = langid.op6_rank_order_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    held_out = [row for row in rows if row.held_out]
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in rows)
    assert sum(row.lang == row.lang_pred for row in held_out) >= 0.95 * len(held_out)
    assert all(0 <= row.score <= 1 for row in rows)


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (None, "und"), (5, "en")} <= got
    assert langid.predict(odd).count() == odd.count()
    assert langid.predict(none).collect() == []
    assert {r.lang_pred for r in langid.classify(odd, langid.profiles(none), "text", "p", "s").select("p").withColumnRenamed("p", "lang_pred").collect()} == {"und"}


def test_many_languages_are_compared_in_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = langid.profiles(docs)
    whole = langid.classify(docs, learned, "text", "p", "s").select("doc_id", "p", "s").collect()
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 1)
    assert sorted(langid.classify(docs, learned, "text", "p", "s").select("doc_id", "p", "s").collect()) == sorted(whole)
