from accountlens.llm import rollups
from accountlens.session import new_shared_path


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_batches(spark, odd, none):
    rollup = rollups.Rollup(spark, new_shared_path(spark, "test-rollup"))
    old, new = rollups.counts(odd, "blank-1"), rollups.counts(odd.where("doc_id = 6"), "class-2")
    rollup.commit("1", rollups.inserts(old))
    first = totals(rollup)
    assert first["b", "en", "blank-1"] == (4, 240_000) and first[None, None, "blank-1"] == (1, 0) and first[None, "en", "blank-1"] == (1, 0)
    rollup.commit("1", rollups.inserts(old))  # a repeated commit changes nothing
    assert totals(rollup) == first
    rollup.commit("2", rollups.revisions(old.where("doc_id = 6"), new))
    revised = totals(rollup)
    assert revised["b", "en", "blank-1"] == (2, 120_000) and revised["b", "en", "class-2"][0] == 2
    rollup.commit("empty", rollups.inserts(rollups.counts(none, "blank-1")))
    assert totals(rollup) == revised and {r.batch for r in rollup.batches().collect()} == {"1", "2", "empty"}
    assert totals(rollup.compacted(new_shared_path(spark, "test-rollup"))) == revised
    rollup.commit("3", rollups.deletes(new))
    rollup.commit("4", rollups.deletes(old.where("doc_id is null or doc_id <> 6")))
    assert totals(rollup) == {}
    rollup.commit("4", rollups.deletes(none.limit(0).transform(lambda x: rollups.counts(x, "blank-1"))))
    assert totals(rollup) != {}


def test_order_of_batches(spark, odd):
    counted = rollups.counts(odd, "blank-1")
    one, other = (rollups.Rollup(spark, new_shared_path(spark, "test-rollup")) for _ in range(2))
    batches = [("a", rollups.inserts(counted)), ("b", rollups.deletes(counted.where("doc_id = 4")))]
    for rollup, order in ((one, batches), (other, batches[::-1])):
        for name, rows in order:
            rollup.commit(name, rows)
    assert totals(one) == totals(other)


def test_replays_after_compaction_do_nothing(spark, odd):
    rollup = rollups.Rollup(spark, new_shared_path(spark, "test-rollup"))
    rows = rollups.inserts(rollups.counts(odd, "blank-1"))
    for name in ("1", "2"):
        rollup.commit(name, rows)
    folded = rollup.compacted(new_shared_path(spark, "test-rollup"))
    before = totals(folded)
    assert before == totals(rollup) and before["b", "en", "blank-1"] == (8, 480_000)
    for name in ("1", "2", "compacted"):
        if name != "compacted":
            folded.commit(name, rows)
    assert totals(folded) == before
    folded.commit("3", rows)
    again = folded.compacted(new_shared_path(spark, "test-rollup"), "compacted-2")
    for name in ("1", "2", "3", "compacted"):
        again.commit(name, rows)
    assert totals(again) == totals(folded) and totals(again)["b", "en", "blank-1"] == (12, 720_000)
    assert {"1", "2", "3"} <= {r.batch for r in again.batches().collect()}
