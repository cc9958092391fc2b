import hashlib
import re

from pyspark.sql import functions as F

from accountlens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c@d.e a@b.c_d@e.f .@. x@y z@1.2 %@-.-. a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.0.0 1.2.3 01.02.03.04x9.9.9.999",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 00000000000000 9 9",
    "+1 (555) 123-4567, +1 (555) 123-45678901234, ++49 30 1234567 +5- +12345678 9",
    "\U0001f600 é a@b.cd  +44 20 7946 0958\U0001f600 1.1.1.1",
    "", None,
]


def passes(kind, match):
    digits = [int(x) for x in match if x.isdigit()]
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text or "") if passes(kind, m.group())]


def shown(rows):
    return {row.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in row.base] for row in rows}


def test_base_spans(spark, sf_dir, texts):
    rows = pii.op7_contextual_pii(spark, sf_dir).collect()
    for row in rows:
        want = plain(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x.startswith(kind) for x in want) for kind in PLAIN]
        assert set(want) <= set(row.spans.split(",")) | {""}
    assert len(rows) == len(texts)


def test_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    assert shown(pii.entities(docs).collect()) == {i: plain(text) for i, text in enumerate(HARD)}


def test_long_runs_take_linear_time(spark):
    runs = ["a" * 300_000, "1" * 300_000, "1 " * 100_000, "a@" * 50_000, "1." * 100_000, "+1" * 100_000, "*" * 200_000 + "1a" * 3]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    assert pii.entities(docs).count() == len(runs)


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"Filler words here. Please ring mobile number +1 (555) 010-{i:04d} today or later" for i in range(1000, 1012)]
    docs = [*seeds, "We know. Please ring mobile number (555) 010-9999 today as well", "The year 1999 and the total 12345678 are no identifiers", "Please ring mobile number tomorrow"]
    rows = pii.entities(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    added = {row.doc_id: [docs[row.doc_id][x.start : x.end] for x in row.spans if x not in row.base] for row in rows}
    assert added.pop(len(seeds)) == ["(555) 010-9999"]
    assert not any(added.values())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pii.scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mask(spark, odd, none):
    docs = odd.withColumn("text", F.when(F.col("doc_id") == 4, "mail a.b@c.de or \U0001f600 4111111111111111.").otherwise(F.col("text")))
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    got = {row.doc_id: row.text for row in masked.collect()}
    assert got[4] == "mail <EMAIL> or \U0001f600 <CARD>." and got[1] is None and got[2] == ""
    assert pii.mask(none).collect() == [] and pii.entities(none).collect() == []


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (1, "x"), (None, "a@b.cd")], "doc_id long, text string")
    assert sorted(len(row.spans) for row in pii.entities(docs).collect()) == [0, 1, 1, 1]


def added(spark, docs):
    rows = pii.entities(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    return sorted(docs[row.doc_id][x.start : x.end] for row in rows for x in row.spans if x not in row.base)


def test_unseen_identifiers_do_not_speak_against_their_pattern(spark):
    local = [f"(555) 010-{i}" for i in range(2000, 2040)]
    docs = [f"Please ring mobile number +1 (555) 010-{i} today" for i in range(1000, 1010)] + [f"Please ring mobile number {x} today" for x in local]
    # Here three tokens of no kind speak against it.
    docs += [f"Our stock article +1 (555) 010-{i} sells" for i in range(1000, 1003)] + [f"Our stock article {x} sells" for x in ("12ab34", "56cd78", "91ef23", "555 010 8888")]
    assert added(spark, docs) == local


def test_long_chains_of_patterns(spark):
    places = ["alpha gate", "bravo hall", "cedar lane", "delta road", "ember park", "fable bank", "grove mill"]
    numbers = [[f"+1 (555) 010-{i}" for i in range(1000, 1004)]] + [[f"(555) 010-{k}{i:03d}" for i in range(4)] for k in range(2, 2 + len(places))]
    docs = [f"see {place} {x} there" for place, old, new in zip(places, numbers, numbers[1:]) for x in (*old, *new)]
    assert added(spark, docs) == sorted(x for own, times in zip(numbers[1:], [2] * (len(places) - 1) + [1]) for x in own * times)


def test_contexts_are_taken_by_place(spark):
    """A number before the words around an identifier takes nothing from its context, whichever pattern finds it."""
    docs = [f"Order 1234{i} phone +1 (555) 010-{i} please" for i in range(1000, 1006)] + ["Order 77777 phone (555) 010-9999 please"]
    rows = pii.occurrences(pii.scanned(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))).collect()
    found = {tuple(row.patterns) for row in rows if row.instance.startswith(("+1 (555)", "(555)"))}
    assert found == {("before:order phone", "around:phone _ please")}
    assert added(spark, docs) == ["(555) 010-9999"]


def test_words_cut_by_the_context_do_not_count(spark):
    long = "x" * 200
    rows = pii.occurrences(pii.scanned(spark.createDataFrame([(1, f"{long} call +1 (555) 010-1000 {long}")], "doc_id long, text string"))).collect()
    assert [row.patterns for row in rows] == [["before: call", "around:call _ "]]


def test_many_entities_in_one_text(spark):
    """Addresses and other tokens side by side, thousands of them: overlaps are seen in one pass."""
    text = " ".join(f"10.{i % 256}.{i // 256}.7 ticket-{i + 1000}" for i in range(2_000))
    (row,) = pii.entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [f"{x.kind}:{x.start}:{x.end}" for x in row.base] == plain(text) and len(row.base) == 2_000
    (masked,) = pii.mask(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert masked.text.split()[:2] == ["<IP>", "ticket-1000"] and masked.text.count("<IP>") == 2_000
