import random

import duckdb

from accountlens.llm import decontaminate as d

ITEM = "Yesterday the baker Tom sold 12 loaves for 30 dollars and then Tom gave 12 rolls to the old teacher who lived next door"


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items=((1, ITEM),)):
    return {(r.doc_id, r.item_id): r for r in d.contaminated(*frames(spark, docs, items)).collect()}


def test_planted_items_are_found_and_nothing_else(spark, sf_dir, texts):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    want = {(doc, item) for doc, text in texts.items() for item, passage in items if passage in (text or "")}
    got = {(r.doc_id, r.item_id) for r in d.op1_template_decontamination(spark, sf_dir).collect()}
    assert want and got == want


def test_reparametrised_questions(spark):
    again = ITEM.replace("Tom", "Ann").replace("12", "7").replace("30", "9.50").replace("dollars", "euros")
    inconsistent = ITEM.replace("Tom sold 12", "Tom sold 7", 1)
    rows = found(spark, [(1, "Before. " + again + " and more."), (2, inconsistent), (3, ITEM.lower()), (4, "x " * 30 + ITEM), (5, "something else altogether " * 9)])
    assert (1, 1) in rows and not rows[1, 1].exact
    assert rows[4, 1].exact and rows[4, 1].covered > 0.9  # its first word looks like a name there
    assert (2, 1) not in rows and (5, 1) not in rows


def test_short_items_and_ties(spark):
    items = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "5 kg"), (4, None), (5, ""), (None, ITEM)]
    rows = found(spark, [(1, "we saw alpha beta gamma delta there"), (1, "we saw alpha beta gamma delta there"), (2, "alpha beta gamma"), (None, ITEM)], items)
    assert set(rows) == {(1, 1), (1, 2)}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, ITEM, "clash")], "item_id long, text string, doc_id string")
    assert d.contaminated(odd, items).collect() == []
    assert d.contaminated(none, items).collect() == []
    assert d.contaminated(odd, items.where("false")).collect() == []
    assert [r.doc_id for r in d.contaminated(odd.withColumnRenamed("text", "old").selectExpr("doc_id", f"'{ITEM}' as text", "old as template").where("doc_id = 4"), items).collect()] == [4]


def test_copies_of_any_item_whatever_its_case_and_literals(spark):
    items = [
        (1, ITEM), (2, "The Old Man And The Sea By Ernest Hemingway"), (3, "Compute 3 + 4 * 12 - 7 * 15 + 8 / 2 and 9 - 1"),
        (4, "Anna Berta Clara Dora Emma Frieda Greta Hanna Ida"), (5, "日本の首都はどこですか"), (6, "5 kg"), (7, "Straße nach Süden"), (8, "!!!"),
    ]
    docs = [(100 + item, f"x y z {text} and so on") for item, text in items]
    docs += [(200 + item, f"x y z {text.lower()} and so on") for item, text in items] + [(300 + item, f"x y z {text.upper()} and so on") for item, text in items]
    docs += [(405, "これは日本の首都はどこですかという問題"), (403, "Compute 5 + 6 * 13 - 8 * 16 + 9 / 3 and 7 - 2"), (406, "6 kg"), (404, "Otto Paul Quirin Rolf Sepp Toni Udo Veit Willi")]
    rows = found(spark, docs, items)
    assert set(rows) == {(n + item, item) for n in (100, 200, 300) for item, _ in items if item != 8} | {(405, 5), (403, 3)}
    assert all(row.covered == 1 for (doc, item), row in rows.items() if item not in (1, 7) or doc < 300)
    assert not rows[403, 3].exact


def test_slots_are_one_to_one(spark):
    item = "Lena paid 3 euros for bread and 5 euros for milk and 7 euros for cheese at the market"
    rows = found(spark, [(1, item.replace("3", "11").replace("5", "12").replace("7", "13")), (2, item.replace("3", "11").replace("5", "11").replace("7", "11"))], [(1, item)])
    assert set(rows) == {(1, 1)}


def test_windows_of_few_literals_count_as_a_whole(spark):
    item = "Which is larger Anna Berta Clara Dora Emma Frieda Greta"  # two windows with three and two literals
    other = "Which is larger Otto Paul Quirin Rolf Sepp Toni Udo"
    docs = [(1, f"We ask: {other}"), (2, "We ask: Which is larger Otto Paul Quirin Rolf Sepp. But the rest is not there"), (3, "We ask: Which is larger Otto Paul Otto Rolf Sepp Toni Udo")]
    assert set(found(spark, docs, [(1, item)])) == {(1, 1)}


def plain_tokens(text):
    """[(token, kind)] by the rules of the module's docstring, word by word."""
    out, starts = [], True
    for word in (text or "").split():
        raw = d.TOKEN.findall(word)
        for i, token in enumerate(raw):
            kind = d.kind_of(token.casefold())
            name = i == 0 and token[0].isupper() and kind == d.LITERAL and not starts
            out.append((token.casefold(), d.NAME if name else kind))
        starts = bool(d.SENTENCE_END.search(word))
    return out


def plain_windows(text, size):
    """{place: (template, slots, literals)} and {place: values}."""
    tokens = plain_tokens(text)
    templates, values = {}, {}
    for at in range(len(tokens) - size + 1):
        own = tokens[at : at + size]
        literals = sum(kind == d.LITERAL for _, kind in own)
        if literals >= d.FEW:
            templates[at] = (tuple(d.PLACEHOLDER.get(kind, token) for token, kind in own), tuple(token for token, kind in own if kind), literals)
        values[at] = tuple(token for token, _ in own)
    return templates, values


def plain_contaminated(docs, items):
    """Every pair of a document and an item, every diagonal."""
    out = {}
    for item, text in items:
        size = min(d.WINDOW, len(plain_tokens(text)))
        if not size:
            continue
        least = d.FEW if size == d.WINDOW else d.LITERALS
        templates, values = plain_windows(text, size)
        templates = {at: x for at, x in templates.items() if x[2] >= least}
        strong = {at for at, x in templates.items() if x[2] >= d.LITERALS}
        for doc, body in docs:
            there, there_values = plain_windows(body, size)
            lines = {}
            for at, (template, slots, _) in templates.items():
                for place, (other, here, _) in there.items():
                    if other == template:
                        lines.setdefault(place - at, []).append((at, at in strong, False, list(zip(slots, here, strict=True))))
            for at, own in values.items():
                for place, other in there_values.items():
                    if other == own:
                        lines.setdefault(place - at, []).append((at, False, True, []))
            found_places, found_strong, found_any, run, exact = set(), set(), set(), 0, True
            for windows in lines.values():
                pairs = {pair for *_, slots in windows for pair in slots}
                if not len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    continue
                telling = {at for at, is_strong, is_plain, _ in windows if is_strong or is_plain}
                found_places |= telling
                found_strong |= {at for at, is_strong, _, _ in windows if is_strong}
                found_any |= {at for at, _, is_plain, _ in windows if not is_plain}
                if telling:
                    run = max(run, min(max(telling) - min(telling) + size, len(telling) + size - 1))
                exact = exact and all(a == b for a, b in pairs)
            shares = [len(found_places) / len(values)]
            shares += [len(found_strong) / len(strong)] if strong else []
            shares += [1.0] if templates and found_any == set(templates) else []
            if lines and (max(shares) >= d.COVERED or run >= d.RUN):
                out[doc, item] = (max(shares), run, exact)
    return out


def test_alignments_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["the", "old", "Tom", "Ann", "12", "7", "kg", "sold", "and", "bread.", "Berlin", "+", "for", "x", "9.5", "euros", "in"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 6, 9, 15, 25])))) for i in range(12)]
    docs = []
    for i in range(80):
        _, text = rng.choice(items)
        own = text.split()
        cut = own[rng.randint(0, len(own) // 2) : len(own) - rng.randint(0, len(own) // 3)] if rng.random() < 0.6 else own
        swaps = dict(zip(["12", "7", "9.5"], rng.choices(["12", "7", "9.5", "33", "4"], k=3), strict=True)) | dict(zip(["Tom", "Ann", "Berlin"], rng.choices(["Tom", "Ann", "Berlin", "Eva"], k=3), strict=True))
        changed = [swaps.get(w, w) if i % 3 else w for w in cut]
        docs.append((i, " ".join([*rng.choices(words, k=rng.randint(0, 9)), *changed, *rng.choices(words, k=rng.randint(0, 9))])))
    got = {key: (row.covered, row.run, row.exact) for key, row in found(spark, docs, items).items()}
    want = plain_contaminated(docs, items)
    assert got == want and len(want) > 20 and not all(exact for *_, exact in want.values())
