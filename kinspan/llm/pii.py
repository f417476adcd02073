"""Personal data in texts, by DataFrame functions only.

Patterns propose spans. Checks confirm them: parts of an address at most 255,
Luhn's sum for card numbers, the remainder 1 modulo 97 for account numbers, the
number of digits for phones, the ranges in use for social security numbers. Words near
a span raise its score. Spans of the base kinds stay whatever their score; the others
need LEAST_SCORE: an account number has it by its remainder, a social security number
reaches it only with a word that speaks for it.

The patterns are written so that Java's matcher needs no recursion and each byte
is looked at a bounded number of times: repetitions are possessive where what
follows cannot begin with what is repeated, and a match can begin only where a run
begins or the last match ended. The matches are those of the plain patterns; an account
number's pattern looks ahead from its first letter, and each end of a word within
its reach is tried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, read_table

#: Code points before a span, and behind it, in which context words count.
CONTEXT_CHARS = 40
CONTEXT_BEHIND = 24
CONTEXT_BONUS = 0.2
#: Spans beside the base kinds need this score.
LEAST_SCORE = 0.6
#: Characters of the account numbers of a country.
ACCOUNT_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
SPAN = "struct<start:int,kind_no:int,stop:int,kind:string,score:double>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that every text with a match passes.
    needs: str
    score: float
    context: str
    base: bool = True
    #: The pattern consumes a letter and its first group looks ahead from there.
    ahead: bool = False


#: The patterns, and the words that speak for a kind.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo)\b"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.6, r"(?i)\b(?:ip|address|server|host|adresse|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, r"(?i)\b(?:card|credit|visa|debit|karte|carte|tarjeta)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|appel)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]", "", 0.7, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", base=False, ahead=True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.5, r"(?i)\b(?:ssn|social security|social insurance)\b", base=False),
)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its own digits summed."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(match: Column) -> Column:
    """An account number with its first four characters behind, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
        return F.when(c == "", acc).otherwise((acc * F.when(value > 9, 100).otherwise(10) + value) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _account(ahead: Column) -> Column:
    """The account number that begins ``ahead`` and ends with one of its words, or null;
    of several one of its country's length, else the longest."""
    words = F.split(ahead, " ")
    tried = F.transform(words, lambda _, i: F.array_join(F.slice(words, F.lit(1), i + 1), " "))

    def length(match: Column) -> Column:
        return F.length(F.replace(match, F.lit(" "), F.lit("")))

    sound = F.filter(tried, lambda m: F.rlike(m, F.lit("[A-Z0-9]$")) & length(m).between(15, 34) & _mod97(m))
    lengths = F.create_map(*[F.lit(x) for pair in ACCOUNT_LENGTHS.items() for x in pair])
    usual = F.filter(sound, lambda m: length(m) == F.try_element_at(lengths, F.substring(m, 1, 2)))
    return F.coalesce(F.try_element_at(usual, F.lit(1)), F.try_element_at(sound, F.lit(-1)))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "ssn":
        return ~F.rlike(match, F.lit("^(?:000|666|9)|-00-|-0000$"))
    return F.lit(True)


def _proposals(text: Column, kind: Kind) -> Column:
    """(gap, match) pairs: the text before a match since the last one, and the match;
    the last pair has no match. Null where the text cannot have any."""
    pieces = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), int(kind.ahead)), lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    might = F.contains(text, F.lit(kind.needs)) if kind.needs else F.rlike(text, F.lit("[0-9]"))
    return F.when(might, pieces)


def _spans(text: Column, pairs: Column, kind: Kind, number: int) -> Column:
    """The confirmed spans of a kind; code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc.at + p.gap
        end = begin + F.coalesce(F.length(p.match), F.lit(0))
        found = F.struct(begin.alias("start"), end.alias("stop"))
        out = F.when(p.match.isNotNull() & _valid(kind.name, p.match), F.concat(acc.out, F.array(found))).otherwise(acc.out)
        return F.struct(end.alias("at"), out.alias("out"))

    def step_ahead(acc: Column, p: Column) -> Column:
        """Matches consume one letter; a number within the last one is none."""
        begin = acc.at + p.gap
        stop = begin + F.length(_account(p.match))
        free = begin >= F.coalesce(F.try_element_at(acc.out, F.lit(-1)).stop, F.lit(0))
        out = F.when(stop.isNotNull() & free, F.concat(acc.out, F.array(F.struct(begin.alias("start"), stop.alias("stop"))))).otherwise(acc.out)
        return F.struct((begin + F.when(p.match.isNotNull(), 1).otherwise(0)).alias("at"), out.alias("out"))

    found = F.aggregate(pairs, start, step_ahead if kind.ahead else step, lambda acc: acc.out)

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s.start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s.start, F.lit(CONTEXT_CHARS)))
        behind = F.substring(text, s.stop + 1, F.lit(CONTEXT_BEHIND))
        near = F.rlike(before, F.lit(kind.context)) | F.rlike(behind, F.lit(kind.context))
        score = F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        return F.struct(s.start.alias("start"), F.lit(number).alias("kind_no"), s.stop.alias("stop"), F.lit(kind.name).alias("kind"), F.round(score, 2).alias("score"))

    spans = F.transform(found, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s.score >= LEAST_SCORE)
    return F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, text_col: str = "text", name: str = "pii_spans") -> DataFrame:
    """``docs`` and pii_spans: array of (start, kind_no, stop, kind, score), by start and kind.

    Null and empty texts have no spans; texts of any length are searched whole; repeated
    rows give repeated results. Other columns pass unchanged, whatever their names (but a
    column named as the result, ``name``, is replaced).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [fresh(docs.columns, f"pii_{k.name}") for k in KINDS]
    found = docs.withColumns({name: _proposals(text, kind) for name, kind in zip(names, KINDS, strict=True)})
    found = found.withColumns({name: _spans(text, F.col(name), kind, i) for i, (name, kind) in enumerate(zip(names, KINDS, strict=True))})
    return found.withColumn(name, F.array_sort(F.concat(*names))).drop(*names)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans
    give one replacement, named by the first. Null text stays null; all other columns
    pass unchanged, whatever their names."""
    text = F.col(text_col).cast("string")
    spans = fresh(docs.columns, "pii_spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))
        after = F.struct(s.stop.alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), tag).alias("out"))
        return F.when(s.start >= acc.at, after).otherwise(F.struct(F.greatest(acc.at, s.stop).alias("at"), acc.out.alias("out")))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    out = find_pii(docs, text_col, spans)
    return out.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(F.col(text_col))).drop(spans)


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, counts of the base kinds, base_sha256, spans, scores.

    A null doc_id stays null; an empty table gives no rows.
    """
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")

    bases = [i for i, k in enumerate(KINDS) if k.base]

    def count(i: int) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s.kind_no == i)).cast("long").alias(f"n_{KINDS[i].name}")

    return found.select(
        "doc_id",
        *[count(i) for i in bases],
        F.sha2(joined(F.filter("pii_spans", lambda s: s.kind_no < len(bases))), 256).alias("base_sha256"),
        joined(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda s: s.score.cast("string")), ",").alias("scores"),
    )
