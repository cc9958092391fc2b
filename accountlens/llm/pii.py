"""Personal data: base patterns, and identifiers discovered by bootstrapped context.

Base entities are regular expressions with checks. They are also the seeds of a bootstrap: the words around
a seed make lexical patterns, and identifier-like tokens that no base pattern takes are the candidates. Spark
scores the bipartite graph of patterns and instances in rounds: a pattern is worth the share that trusted
instances of its kind have of those that speak for or against it; against it are those of another kind or without
a shape, and unseen ones of its kind's shape say nothing. An instance is trusted if it is a seed or has a confident,
well supported pattern. Rounds go on until no more are trusted. A candidate in the context of a confident pattern is
a discovered identifier of the kind whose shape it has.

Everything is DataFrame functions. Texts are scanned once; what is found in a text stays in its row, and only
found tokens, with the text next to them, are shuffled.

Defined cases: a null text is empty, an empty text has no spans; a null doc_id is scanned like any other and
kept apart by its text's hash; repeated rows get equal results each; the base spans of one kind never overlap,
those of two kinds may; an empty table gives an empty result; other columns are ignored (mask() keeps them).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountlens.llm.common import fresh, staged, table
from accountlens.session import checkpointed

KINDS = ["email", "ip", "card", "phone"]

# What the base kinds match. (?<!x)|\G starts a match only where a run of x starts or the last match
# ended, and possessive quantifiers give nothing back; both leave the matches as they are and the time linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Tokens with an @ or three digits; number groups behind a blank belong to the token before.
CANDIDATE = r"(?<!\S)(?=[^\s@]*+@|[^\s0-9]*+[0-9][^\s0-9]*+[0-9][^\s0-9]*+[0-9])\S++(?: [(]?[0-9][0-9().-]++)*+"
#: Shapes of discovered identifiers; digits are counted apart.
SHAPES = {
    "email": r"^[^A-Za-z0-9@]*+[A-Za-z0-9][^@]*+@[^A-Za-z0-9@]*+[A-Za-z0-9][^@]*+$",
    "ip": r"^[0-9]++(?:\.[0-9]++){3}$|^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9](?:[ .-]?[0-9])++$",
    "phone": r"^[(]?[0-9][0-9 ().-]*[0-9]$",
}
DIGITS = {"card": (12, 19), "phone": (7, 15)}

#: A pattern needs so many trusted instances, and to be worth so much.
SUPPORT, CONFIDENT = 3, 0.8
#: Characters on either side of a token in which its context is looked for.
CONTEXT = 80
#: Matches that are put together at a time; characters of a block of text.
BLOCK, PIECE = 128, 1024

FOUND = "struct<start:int,end:int,token:string>"
PLACED = "array<struct<start:int,end:int,token:string,left:string,right:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often, and in whichever lambda, `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, state: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """What `step` makes, item by item, of the state so far and an item: struct(state, out); the array of all out.

    Appending copies what is there, so results are appended to blocks and blocks to the whole.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(done: Column, x: Column) -> Column:
        return let(step(done.state, x), lambda y: F.struct(y.state.alias("state"), F.concat(done.out, F.array(y.out)).alias("out")))

    def block(done: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(done.state.alias("state"), none.alias("out")), one)
        return let(own, lambda x: F.struct(x.state.alias("state"), F.concat(done.out, F.array(x.out)).alias("out")))

    def whole(every: Column) -> Column:
        count = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int"))
        parts = F.transform(count, lambda i: F.slice(every, i * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(every) == 0, none).otherwise(F.aggregate(parts, start, block, lambda done: F.flatten(done.out)))

    return let(items, whole)


def found_in(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches with their places in code points."""
    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))

    def step(at: Column, x: Column) -> Column:
        begin = at + F.length(x.b)
        end = begin + F.length(x.m)
        return F.struct(end.alias("state"), F.struct(begin.alias("start"), end.alias("end"), x.m.alias("token")).alias("out"))

    def pairs(p: Column) -> Column:
        return F.zip_with(p.m, F.slice(p.b, F.lit(1), F.size(p.m)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))

    return running(let(pieces, pairs), F.lit(0), FOUND, step)


def blocks(text: Column) -> Column:
    """The text in blocks of PIECE code points, so that a place in it is found without reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(pieces: Column, begin: Column, end: Column) -> Column:
    """The code points from begin to end of a text in blocks."""
    first = F.floor(begin / PIECE).cast("int")
    count = F.floor((F.greatest(end, begin + 1) - 1) / PIECE).cast("int") - first + 1
    whole = F.array_join(F.slice(pieces, first + 1, count), "")
    return F.when(end > begin, whole.substr(begin - first * PIECE + 1, end - begin)).otherwise("")


def around(text: Column, x: Column) -> Column:
    """A match with the text (its blocks and size) on either side of it, as far as CONTEXT goes and without words that it cuts."""
    pieces, size = text.pieces, text.size
    left = part_of(pieces, F.greatest(x.start - CONTEXT - 1, F.lit(0)), x.start)
    right = part_of(pieces, x.end, F.least(x.end + CONTEXT + 1, size))
    return F.struct(
        x.start.alias("start"), x.end.alias("end"), x.token.alias("token"),
        F.when(x.start > CONTEXT, F.regexp_replace(left, r"^[\p{L}']++", "")).otherwise(left).alias("left"),
        F.when(x.end + CONTEXT < size, F.regexp_replace(right, r"(?<![\p{L}'])[\p{L}']++$", "")).otherwise(right).alias("right"),
    )


def digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(backwards: Column) -> Column:
        def step(done: Column, i: Column) -> Column:
            once = backwards.substr(i, F.lit(1)).cast("int")
            twice = once * 2 - F.when(once > 4, 9).otherwise(0)
            return done + F.when(i % 2 == 0, twice).otherwise(once)

        return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), step)

    return let(F.reverse(number), total) % 10 == 0


def holds(kind: str, token: Column) -> Column:
    """The check behind a base pattern."""
    number = digits(token)
    if kind == "ip":
        return token.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return let(number, lambda n: F.when(F.length(n).between(13, 19), luhn(n)).otherwise(False))
    return F.length(number).between(9, 15) if kind == "phone" else F.lit(True)


def passing(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: holds(kind, x.token))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, other): what the texts of docs (doc_id, text) hold.

    key tells rows of one doc_id apart by their texts; other: the candidates, those that overlap base matches too.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    none = F.array().cast(f"array<{FOUND}>")
    held = {}
    for kind in KINDS:
        may = F.contains("text", F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else F.col("text").rlike("[0-9]")
        held[kind] = F.when(may, passing(kind, found_in(F.col("text"), BASE[kind]))).otherwise(none).alias(kind)
    held["other"] = F.when(F.col("text").rlike("[0-9@]"), found_in(F.col("text"), CANDIDATE)).otherwise(none).alias("other")

    def placed(found: Column) -> Column:
        several = reduce(or_, [F.size(found[kind]) > 0 for kind in held])
        nothing, text = F.array().cast(PLACED), F.struct(blocks(F.col("text")).alias("pieces"), F.length("text").alias("size"))
        with_context = lambda t: F.struct(*[F.transform(found[kind], lambda x: around(t, x)).alias(kind) for kind in held])
        return F.when(several, let(text, with_context)).otherwise(F.struct(*[nothing.alias(kind) for kind in held]))

    return rows.select("doc_id", "key", let(F.struct(*held.values()), placed).alias("found")).select("doc_id", "key", "found.*")


def word(text: Column, which: int) -> Column:
    """The which-th word next to a token, from its side of the text, in lower case; letters only."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}']+"), F.lit(0))
    return F.coalesce(F.try_element_at(words, F.lit(which)), F.lit(""))


def patterns(left: Column, right: Column) -> Column:
    """The lexical patterns around a token: two words before it, and a word on either side."""

    def made(words: Column) -> Column:
        two = F.concat(F.lit("before:"), words.before, F.lit(" "), words.last)
        both = F.concat(F.lit("around:"), words.last, F.lit(" _ "), words.next)
        return F.when(words.last == "", F.array().cast("array<string>")).otherwise(F.array(two, both))

    return let(F.struct(word(left, -2).alias("before"), word(left, -1).alias("last"), word(right, 1).alias("next")), made)


def trimmed(x: Column) -> Column:
    """A candidate without the punctuation around it."""
    back = F.regexp_replace(x.token, r"(?<![^\p{L}0-9)])[^\p{L}0-9)]++$", "")
    lead = F.length(F.regexp_extract(back, r"^[^\p{L}0-9(]*+", 0))
    core = back.substr(lead + 1, F.length(back))
    begin = x.start + lead
    return F.struct(begin.alias("start"), (begin + F.length(core)).alias("end"), core.alias("token"), x.left.alias("left"), x.right.alias("right"))


def shape(token: Column) -> Column:
    """The kind whose shape a candidate has, or null."""
    number = F.length(digits(token))
    out = F.when(token.rlike(SHAPES["email"]), "email").when(token.rlike(SHAPES["ip"]), "ip")
    for kind in ("card", "phone"):
        out = out.when(token.rlike(SHAPES[kind]) & number.between(*DIGITS[kind]), kind)
    return out


def occurrences(found: DataFrame) -> DataFrame:
    """A row for each base entity, and each candidate that overlaps none: doc_id, key, kind, start, end, instance, seed, patterns.

    Rows equal in doc_id and text count once. Overlaps are seen in one pass over a text's matches by place: none
    that begins before ends behind the candidate's start, and none begins before its end.
    """

    def marked(found: Column | str, kind: str | None) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(bool(kind)).alias("seed"), x.alias("x")))

    marks = F.concat(*[marked(kind, kind) for kind in KINDS], marked("other", None))
    every = found.select("doc_id", "key", F.explode(marks).alias("o")).select("doc_id", "key", "o.kind", "o.seed", "o.x.*")
    every = every.dropDuplicates(["doc_id", "key", "kind", "start", "end"])
    line = Window.partitionBy("doc_id", "key").orderBy("start", F.desc("seed"), "end", "kind")
    ended = F.max(F.when(F.col("seed"), F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("seed"), F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    overlaps = F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))
    apart = every.withColumn("overlaps", overlaps).where("seed OR NOT overlaps")
    x = F.struct("start", "end", "token", "left", "right")
    core = F.when(F.col("seed"), x).otherwise(trimmed(x)).alias("x")
    rows = apart.select("doc_id", "key", "kind", "seed", core).select("doc_id", "key", "kind", "seed", "x.*")
    kind = F.when(F.col("seed"), F.col("kind")).otherwise(shape(F.col("token")))
    return rows.select("doc_id", "key", kind.alias("kind"), "seed", "start", "end", F.lower("token").alias("instance"), patterns(F.col("left"), F.col("right")).alias("patterns"))


def confident_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, worth) of the patterns that the bootstrap over occurrences trusts.

    What is trusted only grows from round to round, and with it the worth of a pattern, so the rounds come to an end.
    """
    edges = found.select(F.explode("patterns").alias("pattern"), "kind", "instance", "seed")
    edges = checkpointed(edges.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")))
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    fitting = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("fitting"))
    # Others would not be worth enough if all their fitting instances were trusted.
    able = fitting.join(size, "pattern").where((F.col("fitting") >= SUPPORT) & (F.col("fitting") / F.col("size") >= CONFIDENT))
    able = able.select("pattern", "kind", (F.col("size") - F.col("fitting")).alias("against"))
    seeds = edges.where("seed").select("kind", "instance").distinct()

    def trusting(typed: DataFrame, more: DataFrame) -> DataFrame:
        joined = typed.join(more.withColumn("more", F.lit(True)), ["kind", "instance"], "left")
        return checkpointed(joined.withColumn("trusted", F.col("trusted") | F.coalesce("more", F.lit(False))).drop("more"))

    typed = trusting(edges.drop("seed").withColumn("trusted", F.lit(False)).join(able, ["pattern", "kind"]), seeds)
    trusted = typed.where("trusted").count()
    while True:
        worth = typed.groupBy("pattern", "kind").agg(F.sum(F.col("trusted").cast("int")).alias("support"), F.max("against").alias("against"))
        worth = worth.select("pattern", "kind", "support", (F.col("support") / F.greatest(F.col("support") + F.col("against"), F.lit(1))).alias("worth"))
        good = checkpointed(worth.where((F.col("worth") >= CONFIDENT) & (F.col("support") >= SUPPORT)).drop("support"))
        typed = trusting(typed, typed.join(good, ["pattern", "kind"], "left_semi").select("kind", "instance").distinct())
        before, trusted = trusted, typed.where("trusted").count()
        if trusted == before:
            return good


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans) of every row of docs (doc_id, text): arrays of (rank of kind, kind, start, end), sorted.

    base holds the base matches, spans those and the discovered ones; end is exclusive.
    """
    found = staged(scanned(docs), "pii")
    seen = occurrences(found)
    good = confident_patterns(seen)
    span = "array<struct<rank:int,kind:string,start:int,end:int>>"
    ranks = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    candidates = seen.where("not seed and kind is not null").withColumn("pattern", F.explode("patterns"))
    added = (
        candidates.join(good, ["pattern", "kind"], "left_semi")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct(ranks[F.col("kind")].alias("rank"), "kind", "start", "end")).cast(span).alias("added"))
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "added")
    )

    def placed(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end")))

    base = F.concat(*[placed(rank, kind) for rank, kind in enumerate(KINDS)])
    rows = found.select("doc_id", "key", F.array_sort(base).cast(span).alias("base"))
    joined = rows.join(added, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(span)))).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with each personal entity in text replaced by its kind in angle brackets; all columns and rows stay."""
    has = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    doc_id, key, spans, row = (fresh(docs, name) for name in ("found_id", "found_key", "found_spans", "found_row"))
    found = entities(docs).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias(doc_id), F.col("key").alias(key), F.col("spans").alias(spans)).distinct()
    touched = docs.where(has).withColumn(row, F.xxhash64("doc_id", "text"))
    rows = touched.join(found, (F.col(row) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc_id)), "left")
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))))
    ends = F.struct(F.length("text").alias("start"), F.length("text").alias("end"), F.lit("").alias("kind"))

    def masked(pieces: Column) -> Column:
        def step(at: Column, x: Column) -> Column:
            name = F.when(x.kind == "", "").otherwise(F.concat(F.lit("<"), F.upper(x.kind), F.lit(">")))
            out = F.when(x.start >= at, F.concat(part_of(pieces, at, x.start), name)).otherwise("")
            return F.struct(F.greatest(at, x.end).alias("state"), out.alias("out"))

        return F.array_join(running(F.concat(in_order, F.array(ends)), F.lit(0), "string", step), "")

    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(let(blocks(F.col("text")), masked)).alias("text")
    return rows.select([text if c == "text" else c for c in docs.columns]).union(docs.where(~has))


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda name: F.concat_ws(",", F.transform(name, lambda x: F.concat_ws(":", x.kind, x.start, x.end)))
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    found = entities(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
