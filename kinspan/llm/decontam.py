"""Benchmark passages in documents, also with other numbers, names or units.

Texts become templates: numbers, units after a number and names (capitalised
words, not in capitals throughout, that do not begin a sentence) turn into typed
placeholders, all other words are folded (Unicode, ``fold``) and stripped of marks
at their ends. A capitalised word that begins a sentence
may be a name or not: windows with one are read both ways. Windows of WINDOW
template tokens of the documents are hash-joined to those of the benchmark, and
windows of the folded words without placeholders beside them. A document holds an
item if enough of the item's windows match: as plain words, or, along one passage, as
templates whose placeholders map to one value each (the slots are consistent). Windows
of one alignment, or of alignments that a few inserted or missing words shift against
each other, are one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, read_table
from .words import LOWER, Words, chunks, mix, powers, ranges, words_of

WINDOW = 8
#: Share of an item's windows that a document must hold.
LEAST_COVERAGE = 0.5
#: Words that may be put in or left out between two windows of one passage.
MOST_SHIFT = 8
#: Windows of the benchmark up to which their hashes go to every task as a filter
#: (8 bytes each); beyond it all windows of the documents are shuffled to the join.
MAX_FILTER = 1_000_000
FILTER_BITS = 22
#: Words that are units when they follow a number.
UNITS = (
    "%", "bytes", "c", "cent", "cents", "cl", "cm", "days", "day", "degrees", "dollars", "eur", "euro", "euros", "f", "feet", "foot", "ft", "g", "gb", "grams", "h", "hour", "hours", "hz", "inch", "inches", "kb", "kg", "kilograms", "kilometers", "km", "kmh", "kw", "l", "lb", "lbs", "liters", "m",
    "mb", "meter", "meters", "mg", "mi", "mile", "miles", "min", "minute", "minutes", "ml", "mm", "month", "months", "mph", "ms", "ounces", "oz", "percent", "pounds", "s", "sec", "second", "seconds", "tons", "usd", "v", "w", "watts", "week", "weeks", "yards", "year", "years",
)
NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64))[0] for k in (1, 2, 3))
KINDS = ("", "number", "name", "unit")

_marks = np.zeros(256, bool)
_marks[[*range(33, 37), *range(38, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_in_number = _digit.copy()
_in_number[[37, 43, 44, 45, 46, 47, 58]] = True
_stop = np.zeros(256, bool)
_stop[[33, 46, 58, 63]] = True


def fold(text: str) -> str:
    """``text`` so that texts that differ in case only are equal (also ß and SS, σ and ς, dotless i)."""
    return text.upper().casefold()


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a chunk's folded texts; the words stay as many and in their order."""
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    texts = [t.lower() if t.isascii() else fold(t.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape") for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


#: Code points below this number are told apart by case; there is none above.
CASED = 0x20000
_cases: list[np.ndarray] = []


def _case_tables() -> list[np.ndarray]:
    """Which code points have another lower case, and which another upper case."""
    if not _cases:
        letters = [chr(i) for i in range(CASED)]
        _cases.append(np.array([c.lower() != c for c in letters]))
        _cases.append(np.array([c.upper() != c for c in letters]))
    return _cases


def cases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether a capital, and whether a small letter, begins there."""
    capital, small = _case_tables()
    point = data.astype(np.int32)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at + more < len(data)]
        value = data[at].astype(np.int32) & (0x3F >> more)
        for j in range(1, more + 1):
            value = value << 6 | (data[at + j] & 0x3F)
        point[at] = np.minimum(value, CASED - 1)
    point[(data >= 0x80) & (data < 0xC0)] = 0
    return capital[point], small[point]


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk of texts, their stripped starts and ends, hashes (of the
    templates, of the folded words, and of templates with names at sentence starts), kinds."""
    words = words_of(data, offsets, fold=LOWER)
    starts, ends = words.starts.copy(), words.ends.copy()
    for side, step in ((starts, 1), (ends, -1)):
        live = np.arange(len(starts))
        while len(live):
            at = side[live] - (step < 0)
            live = live[(starts[live] < ends[live]) & _marks[data[np.minimum(at, len(data) - 1)]]]
            side[live] += step
    bare = starts >= ends  # nothing but marks: the word as it stands
    starts[bare], ends[bare] = words.starts[bare], words.ends[bare]
    if not len(starts):
        return words, starts, ends, np.zeros((3, 0), np.uint64), np.zeros(0, np.int8)
    if data.max() < 0x80:
        hashes = words.hashes(starts, ends)
    else:
        other = words_of(*folded(data, offsets))
        hashes = other.hashes(other.starts + (starts - words.starts), other.ends - (words.ends - ends))
    kinds = np.zeros(len(hashes), np.int8)
    lead = data[starts]
    loose = np.concatenate([[0], np.cumsum(~_in_number[data], dtype=np.int32)])
    begins = _digit[lead] | (_digit[data[np.minimum(starts + 1, len(data) - 1)]] & (ends - starts > 1) & np.isin(lead, (43, 45, 46)))
    kinds[begins & (loose[ends] == loose[starts])] = 1
    first = np.zeros(len(hashes), bool)
    first[words.first[:-1][words.counts() > 0]] = True
    lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
    sentence = first.copy()
    sentence[1:] |= _stop[data[words.ends[:-1] - 1]] | (lines[words.starts[1:]] != lines[words.ends[:-1]])
    capital, small = cases(data)
    smalls = np.concatenate([[0], np.cumsum(small, dtype=np.int32)])
    name = capital[starts] & (smalls[ends] > smalls[starts]) & ~bare
    kinds[name & ~sentence] = 2
    after = np.zeros(len(hashes), bool)
    after[1:] = (kinds[:-1] == 1) & ~first[1:]
    kinds[after & np.isin(hashes, _unit_hashes())] = 3
    typed = np.where(kinds == 0, hashes, np.array([0, NUMBER, NAME, UNIT], np.uint64)[kinds])
    return words, starts, ends, np.stack([typed, hashes, np.where(name & (kinds == 0), NAME, typed)]), kinds


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        joined = " ".join(UNITS).encode()
        _units.append(words_of(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).hashes())
    return _units[0]


def windows(words: Words, hashes: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, places (word numbers), hashes and roles of the windows of ``size``
    words. A window of which at least half the words are no placeholders comes as a
    template (role 0), with placeholders also as plain words beside it (role 1); any
    other window comes as plain words alone (role 2). Where names may begin sentences
    the template with these as names comes beside the other one (role 3)."""
    counts = np.maximum(words.counts() - size + 1, 0)
    at = np.repeat(words.first[:-1], counts) + ranges(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    plain = np.concatenate([[0], np.cumsum(kinds == 0)])
    n_plain = plain[at + size] - plain[at]
    parts = []
    typed = 2 * n_plain >= size
    plain = np.concatenate([[0], np.cumsum((kinds == 0) & (hashes[2] == hashes[0]))])
    n_second = plain[at + size] - plain[at]
    for role, keep in enumerate((typed, typed & (n_plain < size), ~typed, (2 * n_second >= size) & (n_second < n_plain))):
        place = at[keep]
        total = np.full(len(place), size, np.uint64)
        for j in range(size):
            total += hashes[(0, 1, 1, 2)[role]][place + j] * powers(size + 2)[0][j + 1]
        parts.append((text[keep], place, mix(total), np.full(len(place), role)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _rows(ids: pa.Array, texts: pa.Array, sizes: list[int] | None, known: np.ndarray | None) -> Iterator[tuple]:
    """(id, hash, place in its text, role, size, slots) of all windows that ``known`` holds.

    Without ``sizes`` a text has windows of WINDOW words, or one of all its words.
    """
    if known is not None:
        maybe = np.zeros(1 << FILTER_BITS, bool)
        mask = np.uint64((1 << FILTER_BITS) - 1)
        maybe[(known & mask).astype(np.int64)] = True
    for at, _, data, offsets in chunks(texts):
        words, starts, ends, hashes, kinds = templates(data, offsets)
        counts = words.counts()
        second = np.where(hashes[2] != hashes[0], np.int8(2), kinds)
        for size in sizes or sorted({min(WINDOW, int(c)) for c in counts if c}):
            text, place, hash_, role = windows(words, hashes, kinds, size)
            if sizes is None:
                keep = np.minimum(counts[text], WINDOW) == size
            elif known is not None:
                keep = np.flatnonzero(maybe[(hash_ & mask).astype(np.int64)])
                near = hash_[keep]
                keep = keep[known[np.minimum(np.searchsorted(known, near), len(known) - 1)] == near]
            else:
                keep = slice(None)
            text, place, hash_, role = text[keep], place[keep], hash_[keep], role[keep]
            for i, p, h, k in zip(text.tolist(), place.tolist(), hash_.view(np.int64).tolist(), role.tolist(), strict=True):
                read = second if k == 3 else kinds
                held = [j for j in range(p, p + size) if read[j]] if k in (0, 3) else []
                slots = [f"{KINDS[read[j]]}:{fold(data[starts[j] : ends[j]].tobytes().decode('utf-8', 'replace'))}" for j in held]
                yield ids[at + i].as_py(), h, p - int(words.first[i]), k, size, slots


def _arrow(id_type: str) -> pa.Schema:
    return pa.schema([("id", pa.string() if id_type == "string" else pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("role", pa.int32()), ("size", pa.int32()), ("slots", pa.list_(pa.string()))])


def template_windows(table: DataFrame, sizes: list[int] | None = None, known: np.ndarray | None = None) -> DataFrame:
    """Windows of ``table`` (id, text); a null text has none."""
    id_type = dict(table.dtypes)["id"]
    schema = _arrow(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: list[tuple] = []
            for row in _rows(batch.column("id"), batch.column("text"), sizes, known):
                waiting.append(row)
                if len(waiting) == 20_000:
                    yield _batch(waiting, schema)
                    waiting = []
            yield _batch(waiting, schema)

    return table.select("id", "text").mapInArrow(run, f"id {id_type}, hash long, place int, role int, size int, slots array<string>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_coverage: float = LEAST_COVERAGE, id_col: str = "doc_id") -> DataFrame:
    """Pairs doc_id, item_id of documents that hold an item, with n_matched and
    n_windows (of the item), coverage, same_slots (no placeholder has another value).
    ``id_col`` names the documents' id, a number or a string.

    The windows are those of which half the words are plain, or all windows of the
    item, whichever are covered better.

    Rows with a null id or text match nothing. Rows of one doc_id count as one
    document; items of one item_id but different texts are held by their windows
    together. Windows of which less than half the words are plain match as they
    stand only. Texts of any length are searched whole; empty texts hold nothing, and an
    empty table of either kind gives no pairs.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    held = template_windows(items).select(F.col("id").alias("item_id"), "hash", F.col("place").alias("item_place"), "role", "size", F.col("slots").alias("item_slots"))
    over = Window.partitionBy("item_id")
    held = held.withColumns({"n_typed": F.count_if(F.col("role") == 0).over(over), "n_all": F.count_if(F.col("role").isin(0, 2)).over(over)})
    sizes = [r["size"] for r in held.select("size").distinct().orderBy("size").collect()]  # at most WINDOW rows
    known = None
    if held.count() <= MAX_FILTER:
        known = np.unique(np.array([r.hash for r in held.select("hash").distinct().collect()], np.int64).view(np.uint64))
    kind = "string" if dict(docs.dtypes)[id_col] == "string" else "long"
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("id"), F.col("text").cast("string").alias("text"))
    if not sizes:
        texts, sizes, known = texts.limit(0), [WINDOW], None
    found = template_windows(texts, sizes, known).select(F.col("id").alias("doc_id"), "hash", "place", "slots", (F.col("role") == 3).alias("second"))
    pairs = found.join(held, "hash").withColumn("diagonal", F.col("place") - F.col("item_place"))
    pairs = pairs.withColumn("second", F.col("second") | (F.col("role") == 3))
    bare, alone = F.size("item_slots") == 0, F.col("role") == 2
    aligned = pairs.groupBy("doc_id", "item_id", "diagonal", "n_typed", "n_all").agg(
        F.collect_set(F.when(bare & ~alone, F.col("item_place"))).alias("plain_places"),
        *[F.collect_set(F.when(~bare & which, F.col("item_place"))).alias(f"{n}_places") for n, which in (("typed", ~F.col("second")), ("second", F.col("second")))],
        F.collect_set(F.when(alone, F.col("item_place"))).alias("lone_places"),
        *[F.array_distinct(F.flatten(F.collect_set(F.when(which, F.arrays_zip("item_slots", "slots"))))).alias(n) for n, which in (("values", ~F.col("second")), ("all_values", F.lit(True)))],
    )

    # One value for each placeholder of the item, and placeholders of one kind only.
    def consistent(values: str) -> Column:
        single = F.size(F.array_distinct(F.transform(values, lambda v: v["item_slots"]))) == F.size(values)
        return single & F.forall(values, lambda v: F.substring_index(v["item_slots"], ":", 1) == F.substring_index(v["slots"], ":", 1))

    def same(values: str) -> Column:
        return F.forall(values, lambda v: v["item_slots"] == v["slots"])

    # A placeholder of the item that has several values in the document, and its own never.
    def contradicted(values: str) -> Column:
        alike = lambda v: F.filter(values, lambda u: u["item_slots"] == v["item_slots"])
        return F.exists(values, lambda v: (F.size(alike(v)) > 1) & ~F.exists(alike(v), lambda u: u["item_slots"] == u["slots"]))

    # Windows that match as plain words count whatever the slots of others are. Those of
    # the second reading count where they agree with all others of their alignment; names
    # at sentence starts that stand for several others refuse it as a whole. A word that
    # is also kept as it stands may be no name, and refuses nothing.
    first, both = consistent("values") & ~contradicted("all_values"), consistent("all_values")
    own = F.when(both, F.array_union("typed_places", "second_places")).when(first, F.col("typed_places")).otherwise(F.array().cast("array<int>"))
    aligned = aligned.select("doc_id", "item_id", "n_typed", "n_all", "diagonal", "plain_places", "lone_places", "typed_places", "second_places", own.alias("own"), F.when(both, same("all_values")).otherwise(same("values")).alias("own_same"), "values", "all_values")
    # A word put in or left out moves the alignment: neighbouring ones are one passage,
    # and its placeholders have to agree from end to end, or its best alignment counts alone.
    over = Window.partitionBy("doc_id", "item_id").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(over) > MOST_SHIFT).cast("int"), F.lit(0))
    chained = aligned.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(over.rowsBetween(Window.unboundedPreceding, 0)))

    def all_of(name: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(name)))

    best = F.struct(F.size("own").alias("n"), (-F.abs("diagonal")).alias("near"), "own", "own_same")
    passages = chained.groupBy("doc_id", "item_id", "n_typed", "n_all", "passage").agg(
        *[all_of(n).alias(n) for n in ("plain_places", "lone_places", "typed_places", "second_places", "values", "all_values")], F.max(best).alias("best")
    )
    typed = F.when(both, F.array_union("typed_places", "second_places")).when(first, F.col("typed_places")).otherwise(F.col("best.own"))
    kept_same = F.when(both, same("all_values")).when(first, same("values")).otherwise(F.col("best.own_same"))
    passages = passages.select("doc_id", "item_id", "n_typed", "n_all", "plain_places", "lone_places", typed.alias("typed"), kept_same.alias("same"))
    whole = passages.groupBy("doc_id", "item_id", "n_typed", "n_all").agg(all_of("plain_places").alias("plain"), all_of("lone_places").alias("lone"), F.collect_list(F.struct("typed", "same")).alias("passages"))
    # Plain words from anywhere, and the placeholders of the passage that adds most.
    counted = F.transform("passages", lambda p: F.struct(F.size(F.array_union("plain", p["typed"])).alias("n"), (p["same"] | (F.size(p["typed"]) == 0)).alias("same")))
    whole = whole.withColumns({"top": F.array_max(counted), "lone": F.size("lone")}).select("doc_id", "item_id", "n_typed", "n_all", "lone", F.col("top.n").alias("typed"), F.col("top.same").alias("same_slots")).where("typed + lone > 0")
    # Of the windows that have a template, or of all windows: whichever share is greater.
    by_typed = (F.col("n_typed") > 0) & (F.col("typed") * F.col("n_all") >= (F.col("typed") + F.col("lone")) * F.col("n_typed"))
    whole = whole.select(
        "doc_id", "item_id", "same_slots",
        F.when(by_typed, F.col("typed")).otherwise(F.col("typed") + F.col("lone")).alias("n_matched"),
        F.when(by_typed, F.col("n_typed")).otherwise(F.col("n_all")).alias("n_windows"),
    )
    whole = whole.withColumn("coverage", F.round(F.col("n_matched") / F.col("n_windows"), 6))
    return whole.where(F.col("coverage") >= least_coverage).select(F.col("doc_id").alias(id_col), "item_id", "n_matched", "n_windows", "coverage", "same_slots")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items; see contaminated for odd rows."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without documents that hold a benchmark item.

    Rows of one doc_id are one document; a row without doc_id is judged by its own text.
    """
    key = fresh(docs.columns, "document")
    name = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.sha2(F.col("text").cast("string"), 256)))
    named = docs.withColumn(key, name)
    found = contaminated(named.select(F.col(key).alias("document"), "text"), benchmark, id_col="document")
    return named.join(found.select(F.col("document").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
