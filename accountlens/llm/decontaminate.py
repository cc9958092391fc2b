"""Benchmark decontamination by templates.

Texts are canonicalised: numbers, units and names (capitalised words inside a sentence) become typed
placeholders, everything else, arithmetic signs too, a case-folded literal without punctuation. Windows of WINDOW
template tokens are joined with those of the benchmark; so are all plain windows, those of the case-folded tokens
with their values, which find copies whatever their case and however few literals they have. Matching windows of a
document and an item that lie on one diagonal are an alignment; it counts only if its slots are consistent, that
is, if each number, unit or name of the item stands for one value in the document wherever it occurs, and no two
for the same. A document is contaminated by an item if consistent alignments cover COVERED of the item's windows
or, by templates alone, of its template windows, or if one of them covers RUN tokens. Template windows with fewer
than LITERALS literals say little on their own: they count only where all of the item's template windows are found
on consistent alignments. Windows with fewer than FEW literals are any list of names or numbers; only their plain
form, with the values, counts.

A bitmap of fixed size, made of the benchmark's window hashes, goes with the scan and keeps almost all
other windows from the join; what it lets through wrongly, the join removes. Joins and groups are on
templates, documents and items only, and the join's benchmark side has few rows per template.

Defined cases: null and empty texts have no window; an item of fewer than WINDOW tokens is one window of its
own length, and one without a token is never matched; letters of scripts without blanks are a token each; a null
doc_id or item_id takes no part;
items and documents that repeat an id are judged as one; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from accountlens.llm.common import Windows, parts, staged, table, utf8, words_of

WINDOW, LITERALS, FEW = 8, 4, 2
COVERED, RUN = 0.5, 20
#: The bitmap has 2**BITMAP_BITS bits, whatever the size of the benchmark.
BITMAP_BITS = 22
#: Words that a task keeps, in round figures, before it starts anew.
KEPT_WORDS = 100_000

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
PLACEHOLDER = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}
# Words for numbers, and units.
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer "
    "kilometers mg g kg gram grams kilogram kilograms tonne tonnes ounce ounces pound pounds ml l litre litres liter "
    "liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees kmh mph $ € £ % °".split()
)
UNSPACED = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
LETTER = rf"[^\W\d_{UNSPACED}]"
#: Signs are tokens where they stand alone or behind a digit.
SIGN = r"[-+*/=<>^×÷−]"
TOKEN = re.compile(rf"[0-9]+(?:[.,:/][0-9]+)*|{LETTER}+(?:['’-]{LETTER}+)*|(?![\W\d_])[{UNSPACED}]|[$€£%°]|^{SIGN}$|(?<=[0-9]){SIGN}(?=[0-9(])")
#: What the template of a plain window begins with, and the seed of its tokens' hashes.
PLAIN, SEED = "::", 1
SENTENCE_END = re.compile(r"[.!?:;|]\W*$")


def kind_of(token: str) -> int:
    if token[0].isdigit() or token in NUMBER_WORDS:
        return NUMBER
    return UNIT if token in UNITS else LITERAL


class Vocabulary:
    """Numbers words; for each the tokens in it, whether the first is capitalised, and whether a sentence ends."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.tokens: list[str] = []
        self.kinds: list[int] = []
        self.codes: list[int] = []
        self.plain: list[int] = []
        self.first: list[int] = [0]
        self.capital: list[bool] = []
        self.ends: list[bool] = []

    def number(self, word: bytes) -> int:
        found = self.numbers.get(word)
        if found is None:
            found = self.numbers[word] = len(self.numbers)
            text = word.decode(errors="replace")
            raw = TOKEN.findall(text)
            for token in raw:
                token = token.casefold()
                kind = kind_of(token)
                self.tokens.append(token)
                self.kinds.append(kind)
                self.codes.append(xxh64_intdigest(PLACEHOLDER[kind] if kind else token))
                self.plain.append(xxh64_intdigest(token, SEED))
            self.first.append(len(self.tokens))
            self.capital.append(bool(raw) and raw[0][0].isupper() and not self.kinds[self.first[-2]])
            self.ends.append(bool(SENTENCE_END.search(text)))
        return found


class Template:
    """The template tokens of some texts, one after the other."""

    def __init__(self, texts: list[bytes | None], vocabulary: Vocabulary):
        numbers, lengths = [], []
        for text in texts:
            own = list(map(vocabulary.number, words_of(text)))
            numbers += own
            lengths.append(len(own))
        words = np.array(numbers, np.int64)
        first = np.array(vocabulary.first, np.int64)
        size = first[words + 1] - first[words]
        where = np.repeat(first[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.kinds = np.array(vocabulary.kinds, np.int8)[where]
        self.codes = np.array(vocabulary.codes, np.uint64)[where]
        self.where, self.vocabulary = where, vocabulary
        text_of_word = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.ones(len(words), bool)
        if len(words):
            starts[1:] = (text_of_word[1:] != text_of_word[:-1]) | np.array(vocabulary.ends, bool)[words[:-1]]
        names = (np.array(vocabulary.capital, bool)[words] & ~starts)[np.repeat(np.arange(len(words)), size)]
        names &= np.arange(len(where)) == np.repeat(np.cumsum(size) - size, size)
        self.kinds[names] = NAME
        self.codes[names] = xxh64_intdigest(PLACEHOLDER[NAME])
        self.text = np.repeat(text_of_word, size)
        self.begin = np.searchsorted(self.text, np.arange(len(lengths)))
        self.length = np.searchsorted(self.text, np.arange(len(lengths)), side="right") - self.begin
        self.windows = Windows(self.codes)
        self.plain_windows = Windows(np.array(vocabulary.plain, np.uint64)[where])
        self.literals = np.concatenate([[0], np.cumsum(self.kinds == LITERAL)])

    def starts(self, size: int, plain: bool) -> np.ndarray:
        """Of the windows of so many tokens within one text; those of a template have FEW literals at least."""
        at = np.arange(max(0, len(self.text) - size + 1))
        at = at[self.text[at] == self.text[at + size - 1]]
        return at if plain else at[self.literals[at + size] - self.literals[at] >= FEW]

    def shown(self, at: int, size: int, plain: bool) -> tuple[str, list[str]]:
        """The template of a window, and what fills its slots."""
        tokens = [self.vocabulary.tokens[i] for i in self.where[at : at + size]]
        if plain:
            return " ".join([PLAIN, *tokens]), []
        kinds = self.kinds[at : at + size].tolist()
        template = " ".join(PLACEHOLDER.get(kind, token) for kind, token in zip(kinds, tokens, strict=True))
        return template, [token for kind, token in zip(kinds, tokens, strict=True) if kind]


ROWS = "id long, place int, template string, slots array<string>"


def _rows(batch: pa.RecordBatch, template: Template, found: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    shown = [template.shown(*one) for one in found]
    at = np.array([at for at, _, _ in found], np.int64)
    texts = template.text[at]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(texts)),
            pa.array((at - template.begin[texts]).astype(np.int32)),
            pa.array([x for x, _ in shown], pa.string()),
            pa.array([x for _, x in shown], pa.list_(pa.string())),
        ],
        names=["id", "place", "template", "slots"],
    )


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole, 1):
            template = Template(utf8(batch.column(1)), Vocabulary())
            short = template.length < WINDOW
            found = [(int(at), WINDOW, plain) for plain in (False, True) for at in template.starts(WINDOW, plain)]
            for at, size in zip(template.begin[short].tolist(), template.length[short].tolist(), strict=True):
                if template.literals[at + size] - template.literals[at] >= LITERALS:
                    found.append((at, size, False))
                if size:
                    found.append((at, size, True))
            yield _rows(batch, template, found)


def _document_windows(bitmap: bytes, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        vocabulary = Vocabulary()
        for whole in batches:
            for batch in parts(whole, 1):
                if len(vocabulary.numbers) > KEPT_WORDS:
                    vocabulary = Vocabulary()
                template = Template(utf8(batch.column(1)), vocabulary)
                found = []
                for size, plain in ((size, plain) for size in sizes for plain in (False, True)):
                    starts = template.starts(size, plain)
                    windows = template.plain_windows if plain else template.windows
                    bit = windows.hashes(starts, size) & np.uint64((1 << BITMAP_BITS) - 1)
                    hit = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                    found += [(int(at), size, plain) for at in starts[hit.astype(bool)]]
                if found:
                    yield _rows(batch, template, found)

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap places of templates."""
    for batch in batches:
        places, sizes = [], []
        for template in batch.column(0).to_pylist():
            tokens = template.split(" ")
            plain = tokens[0] == PLAIN
            codes = np.array([xxh64_intdigest(token, SEED if plain else 0) for token in tokens[plain:]], np.uint64)
            value = Windows(codes).hashes(np.zeros(1, np.int64), len(codes))[0]
            places.append(int(value) & ((1 << BITMAP_BITS) - 1))
            sizes.append(len(codes))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], names=["bit", "size"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").alias("id"), "text").where("id is not null")
    return items.mapInArrow(_item_windows, ROWS)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, run, exact): the items found in each document of docs (doc_id, text).

    covered: share of the item's windows found; run: the longest alignment in tokens; exact: whether all
    slots hold the item's own values.
    """
    items = item_windows(benchmark)
    bits = items.select("template").distinct().mapInArrow(_bits, "bit int, size int")
    bitmap = np.zeros(1 << BITMAP_BITS, np.uint8)
    bitmap[[row.bit for row in bits.select("bit").distinct().collect()]] = 1  # at most 2**BITMAP_BITS numbers
    sizes = [row.size for row in bits.select("size").distinct().collect()]  # at most WINDOW numbers
    scanned = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null")
    found = scanned.mapInArrow(_document_windows(np.packbits(bitmap, bitorder="little").tobytes(), sorted(sizes)), ROWS)
    found = staged(found, "template-windows")
    plain = F.startswith("template", F.lit(PLAIN)).alias("plain")
    width = (F.size(F.split("template", " ")) - plain.cast("int")).alias("width")
    literals = F.size(F.filter(F.split("template", " "), lambda x: ~x.isin(list(PLACEHOLDER.values()))))
    strong = (~plain & (literals >= LITERALS)).alias("strong")
    left = found.select(F.col("id").alias("doc_id"), F.col("place").alias("at"), "template", F.col("slots").alias("here"))
    right = items.select(F.col("id").alias("item_id"), "place", "template", "slots", width, plain, strong)
    pairs = left.join(right, "template").withColumn("diagonal", F.col("at") - F.col("place")).drop("template", "at")
    line = ["doc_id", "item_id", "diagonal"]
    filled = pairs.select(*line, F.explode(F.arrays_zip("slots", "here")).alias("slot")).select(*line, "slot.slots", "slot.here")
    # At most as many values as the item has tokens.
    values = lambda *names: F.size(F.collect_set(F.struct(*names)))
    clashes = filled.groupBy(*line).agg(
        (values("slots", "here") != values("slots")).alias("several"), (values("slots", "here") != values("here")).alias("shared"),
        F.bool_and(F.col("slots") == F.col("here")).alias("same"),
    ).withColumn("clash", F.col("several") | F.col("shared"))
    telling = F.col("plain") | F.col("strong")
    places = lambda wanted: F.collect_set(F.when(wanted, F.col("place")))
    lines = pairs.groupBy(*line).agg(
        places(telling).alias("places"), places(F.col("strong")).alias("by_template"), places(~F.col("plain")).alias("by_any"),
        F.coalesce(F.max(F.when(telling, F.col("place"))) - F.min(F.when(telling, F.col("place"))) + F.max("width"), F.lit(0)).alias("run"), F.max("width").alias("width"),
    )
    # A line with gaps is as long as its windows, not as its ends are apart.
    run = F.when(F.size("places") > 0, F.least("run", F.size("places") + F.col("width") - 1)).otherwise(0)
    kept = lines.join(clashes.drop("several", "shared"), line, "left").where(~F.coalesce("clash", F.lit(False)))
    whole = items.select(F.col("id").alias("item_id"), "place", plain, strong).groupBy("item_id").agg(
        F.count_distinct(F.when(F.col("plain") | F.col("strong"), F.col("place"))).alias("of"),
        F.count_distinct(F.when(F.col("strong"), F.col("place"))).alias("templates"), F.count_distinct(F.when(~F.col("plain"), F.col("place"))).alias("all_templates"),
    )
    distinct = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name))))
    per_pair = kept.groupBy("doc_id", "item_id").agg(
        distinct("places").alias("windows"), distinct("by_template").alias("by_template"), distinct("by_any").alias("by_any"), F.max(run).alias("run"), F.bool_and(F.coalesce("same", F.lit(True))).alias("exact")
    )
    judged = per_pair.join(whole, "item_id")
    shares = [F.col("windows") / F.col("of"), F.when(F.col("templates") > 0, F.col("by_template") / F.col("templates"))]
    shares.append(F.when((F.col("all_templates") > 0) & (F.col("by_any") == F.col("all_templates")), 1.0))
    judged = judged.withColumn("covered", F.greatest(*shares))
    return judged.where((F.col("covered") >= COVERED) | (F.col("run") >= RUN)).select("doc_id", "item_id", "covered", "run", "exact")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
