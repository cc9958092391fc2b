import array
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from accountlens.llm import packing, tokens
from accountlens.llm.tokens import WordTokenizer

PLAIN = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, capacity=packing.CAPACITY):
    """Gapless, within the capacity; the number of sequences and the least possible."""
    sequences = defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append((row.offset, row.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(row.length for row in rows) // capacity)


def test_round_trip(spark, sf_dir, texts):
    rows = packing.op3_linear_grouping_packing(spark, sf_dir).collect()
    want = {}
    for doc, text in texts.items():
        own = ids(text)
        for first in range(0, len(own), 2048):
            part = array.array("I", own[first : first + 2048])
            want[doc, first // 2048] = (first, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used, least = check(rows)
    assert used <= 1.02 * least + 2


def test_plan_is_exact_and_tight():
    rng = random.Random(3)
    for draw in (lambda: rng.randint(1, 2048), lambda: min(2048, int(rng.lognormvariate(6, 1)) + 1), lambda: 700, lambda: rng.choice([1025, 1023, 683, 400])):
        counts = Counter(draw() for _ in range(3000))
        plan = packing.Plan(counts, 2048)
        seen, fill = Counter(), defaultdict(list)
        for length, first, count, sequence, offset in plan.runs:
            for i in range(count):
                seen[length, first + i] += 1
                fill[sequence + i].append((offset, length))
        assert set(seen.values()) == {1} and Counter(length for length, _ in seen) == counts
        for places in fill.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 2048
        assert plan.sequences == len(fill)
    assert packing.Plan({}, 2048).runs == []


def test_word_cache_gives_the_tokenizers_ids():
    tokenizer = WordTokenizer(packing.TOKENIZER)
    for text in ("It's WE'LL 'S a.b. c...d !?e Straße ÉCOLE", "H̱ İ Á.", "<|startoftext|>x <|STARTOFTEXT|> y.", "a\x1fb a\x0bb a b   ΣΑΣ", "x" * 3000, "한국어 中文。 .5 1,000"):
        got = array.array("I", tokenizer.ids(text.encode())).tolist()
        assert got + [0] == ids(text), text


def test_texts_together_give_the_tokenizers_ids(monkeypatch):
    rng = random.Random(5)
    signs = [*"abstEMSÉéß×÷ñ'\"$%&()*+,-./:;<=>?@[\\]^_`{|}~!#01²ªя中—\u00a0  \n\t\x0b\x1f", "'ll", "e\u0301", "≠", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(4000)]
    want = [PLAIN.encode(text, add_special_tokens=False).ids for text in texts]
    tokenizer = WordTokenizer(packing.TOKENIZER)
    got = tokenizer.ids_of([None, *(text.encode() for text in texts)])
    assert got[0] == b"" and [array.array("I", own).tolist() for own in got[1:]] == want
    monkeypatch.setattr(tokens, "STRETCH", 20)  # texts cut at white space
    monkeypatch.setattr(tokens, "KEPT_WORDS", 100)
    again = WordTokenizer(packing.TOKENIZER).ids_of([text.encode() for text in texts[:1000]])
    assert again == got[1:1001]


def test_words_are_kept_without_marks():
    tokenizer = WordTokenizer(packing.TOKENIZER)
    words = [a + b for a in "abcdefghij" for b in ("x", "é")]
    marks = ["$$$", "***", "%", ")", "\"", "...", "&&"]
    text = " ".join(f"({word}{mark}" for word in words for mark in marks)
    assert array.array("I", tokenizer.ids(text.encode())).tolist() + [0] == ids(text)
    assert len(tokenizer.known) <= len(words) + len(marks) + 1


def test_odd_rows(odd, none):
    rows = packing.place(packing.pieces(odd).drop("ids")).collect()
    assert Counter((r.doc_id, r.piece) for r in rows)[6, 0] == 2
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    check(rows)
    assert packing.place(packing.pieces(none)).collect() == []
