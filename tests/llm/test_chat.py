from accountlens.llm import chat

TURNS = "pair_id long, turn long, role string, text string, shown string"


def rows(spark, chosen, rejected):
    frames = [spark.createDataFrame([(*turn, "clash") for turn in side], TURNS) for side in (chosen, rejected)]
    return {r.pair_id: r for r in chat.preferences(*frames).collect()}


def test_prefix_is_rendered_once(spark):
    shared = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi <|end|>")]
    got = rows(spark, [*shared, (1, 2, "assistant", "Héllo"), (1, 3, "user", "x"), (1, 4, "assistant", "y")], [*shared, (1, 2, "assistant", "No")])[1]
    assert got.n_prompt_turns == 2
    assert got.prompt == "<|system|>\nBe brief.<|end|>\n<|user|>\nHi < |end|><|end|>\n"
    assert got.rejected == "<|assistant|>\nNo<|end|>\n"
    cut = [tuple(map(int, span.split(":"))) for span in got.chosen_mask.split(",")]
    assert [got.chosen[a:b] for a, b in cut] == ["Héllo<|end|>\n", "y<|end|>\n"]
    a, b = map(int, got.rejected_mask.split(":"))
    assert got.rejected[a:b] == "No<|end|>\n"


def test_odd_pairs(spark):
    same = [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, None, None)]
    chosen = [*same, (3, 0, "user", "only one side"), (None, 0, "user", "x"), (4, 0, "assistant", ""), (5, 0, "user", "p")]
    rejected = [*same, (None, 0, "user", "x"), (4, 0, "assistant", None), (5, 0, "assistant", "p")]
    got = rows(spark, chosen, rejected)
    assert set(got) == {2, 4, 5}
    assert got[2].n_prompt_turns == 3 and got[2].chosen == got[2].rejected == got[2].chosen_mask == ""
    assert "<|unknown|>\n<|end|>\n" in got[2].prompt
    assert got[4].n_prompt_turns == 1 and got[5].n_prompt_turns == 0 and got[5].prompt == ""
    assert rows(spark, [], []) == {}


def test_long_conversation(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)]
    got = rows(spark, turns, [*turns[:-1], (1, 2999, "user", "other")])[1]
    assert got.n_prompt_turns == 2999 and got.chosen == "<|user|>\nt2999<|end|>\n"


def test_very_long_text(spark):
    long = "wörd <|end|> " * 100_000
    got = rows(spark, [(1, 0, "user", long), (1, 1, "assistant", long + "a")], [(1, 0, "user", long), (1, 1, "assistant", long + "b")])[1]
    assert got.n_prompt_turns == 1 and len(got.prompt) > len(long) and got.chosen != got.rejected
    a, b = map(int, got.chosen_mask.split(":"))
    assert got.chosen[a:b].endswith("a<|end|>\n") and got.chosen[a:b].count("wörd") == 100_000
