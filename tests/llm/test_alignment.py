"""Alignment against one byte at a time, and counts over all documents."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer, decoders

from accountlens.llm import alignment
from accountlens.llm.common import staged

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B))
TO_CHARS = {c: i for i, c in enumerate(sorted(alignment._byte_level(), key=alignment._byte_level().get))}


def tokens(text):
    """[(id, bytes)] on either side, or nothing."""
    if not text:
        return [], []
    a = [(i, bytes(TO_CHARS[c] for c in PLAIN.id_to_token(i))) for i in PLAIN.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()))
    spelt = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == spelt for side in (a, b)) else ([], [])


def groups(text):
    a, b = tokens(text)
    ends = [{}, {}]
    for side, own in zip((a, b), ends, strict=True):
        place = 0
        for k, (_, spelt) in enumerate(side):
            place += len(spelt)
            own[place] = k
    out, i, j = [], 0, 0
    for place in sorted(ends[0].keys() & ends[1].keys()):
        k, m = ends[0][place] + 1, ends[1][place] + 1
        out.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
        i, j = k, m
    assert (i, j) == (len(a), len(b))
    return out


def expected(texts):
    """(doc, text) pairs to the rows of the query."""
    own = [(doc, groups(text)) for doc, text in texts]
    counts = Counter((x[-1], y[-1]) for _, g in own for x, y in g)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = Counter()
    for doc, g in own:
        links = [(x[-1], y[-1]) for x, y in g]
        form = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        rows[
            doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(form.encode()).hexdigest() if form else "",
        ] += 1
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alphabet_is_the_byte_level_one():
    for text in ("aé \n\x00▁", "漢字 \U0001f600"):
        ids = PLAIN.encode(text, add_special_tokens=False).tokens
        assert bytes(TO_CHARS[c] for t in ids for c in t).decode() == text == decoders.ByteLevel().decode(ids)


def test_ranks_give_the_ids_of_the_vocabulary_file():
    ranks, file = alignment.Side(alignment.A), alignment.Side("byte_bpe_50k.json")
    assert file.bytes[: len(ranks.bytes)] == ranks.bytes
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for form in ("a{0}b", " {0}{0} 1{0}", "{0} {0}'s"):
        for first in range(0, len(points), 50_000):
            texts = [" ".join(form.format(c) for c in points[i : i + 500]) for i in range(first, min(first + 50_000, len(points)), 500)]
            assert [x.tolist() for x in ranks.encode(texts)] == file.encode(texts)
    for text in ("a" * 200_000, " " * 100_000, "ab1 " * 50_000, "\n" * 5000 + "x"):
        assert [x.tolist() for x in ranks.encode([text])] == file.encode([text])


def test_query_equals_brute_force(spark, sf_dir, texts, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 100_000)  # many slices ask for the same pairs
    got = Counter(tuple(r) for r in alignment.op12_token_alignment(spark, sf_dir).select(COLUMNS).collect())
    assert got == expected(texts.items())


HARD = [
    " leading", "trailing  ", "a\tb\n\n c", "   ", "x<|endoftext|>y <s> </s> <unk>", "a▁b", "ﬁ ½ ² é İ", "漢字かな 한국어",
    "\U0001f600\U0001f600 zero​width", "\x00\x01 \x7f", "don't   we'll nbsp", "1234567890 12 3", "", None, "word " * 500, "x" * 2000,
]


def test_hard_texts(spark):
    pairs = list(enumerate(HARD)) + [(0, HARD[0]), (None, HARD[1]), (None, None)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").selectExpr("*", "'x' AS slice", "1 AS n_a", "'y' AS Links").coalesce(1)
    sliced = staged(alignment.measured(docs), "aligned")
    own = sliced.where("links IS NOT NULL")
    want = expected(pairs)
    assert Counter(tuple(r) for r in own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").collect()) == Counter(
        {(*k[:5], k[7]): sum(n for j, n in want.items() if (*j[:5], j[7]) == (*k[:5], k[7])) for k in want}
    )
    assert want[HARD.index("a▁b"), 0, 0, 0, 0, 0, 0, ""] == 1


def test_alignments_give_the_groups(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for row in alignment.alignments(docs).collect():
        got, i, j = [], 0, 0
        for x, y in zip(row.a_sizes, row.b_sizes, strict=True):
            got.append((row.a_ids[i : i + x], row.b_ids[j : j + y]))
            i, j = i + x, j + y
        assert got == groups(HARD[row.doc_id])


def test_odd_rows(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = alignment.op12_token_alignment(spark, str(tmp_path / name)).select(COLUMNS).collect()
        assert Counter(tuple(r) for r in rows) == expected([(r.doc_id, r.text) for r in docs.collect()])
