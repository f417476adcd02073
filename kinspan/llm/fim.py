"""Fill-in-middle: a text cut into prefix, middle and suffix, and put together in another order.

One fullmatch of ``(unit)*`` retains every repetition of the group, so that ``ends(1)`` has
the end of each unit: its length is the number of units, and two look-ups in it are the
cuts. The cuts and the form come from a hash of the document's id, never from a generator's
state, so that a repeated task gives the same rows.

A match keeps about fifty bytes a unit. Texts of more than PART_UNITS units are matched in
parts of so many, each from where the last one ended; the ends are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import batches_of
from .shared import read_table

#: Any code point.
CODE_POINT = "."
#: Units of a part that is matched at once.
PART_UNITS = 1 << 20
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain, and so many of the others come suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20


class Units:
    """Ends of the units of texts."""

    def __init__(self, unit: str = CODE_POINT, part: int = PART_UNITS):
        self.part = part
        self.pattern = regex.compile(f"({unit})*", regex.DOTALL)
        self.some = regex.compile(f"({unit}){{1,{part}}}", regex.DOTALL)

    def ends(self, text: str) -> list[int] | np.ndarray:
        """The end of each unit; a text that is no row of units is refused."""
        if len(text) <= self.part:
            found = self.pattern.fullmatch(text)
            if found is None:
                raise ValueError("the text is no sequence of units")
            return found.ends(1)
        at, parts = 0, []
        while at < len(text):
            found = self.some.match(text, at)
            if found is None or found.end() == at:
                raise ValueError("the text is no sequence of units")
            parts.append(np.array(found.ends(1), np.int64))
            at = found.end()
        return np.concatenate(parts)


def numbers_of(seed: str, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed``:doc_id; no id is empty there."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, h: list[int], units: Units) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (null if plain), and the output."""
    ends = units.ends(text)
    n = len(ends)
    if not n or h[2] % 100 >= 100 - PLAIN_PERCENT or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (one, two))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, seed: str = "1", unit: str = CODE_POINT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each text.

    ``unit`` is a pattern of units without groups, one of which matches at any place. Null
    text counts as empty; a null doc_id stays null and is hashed as empty text; rows of one
    id are cut by the same numbers; texts that hold a mark stay plain; texts of any length
    are taken whole; an empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for batch in batches:
            at, names = 0, batch.column("doc_id").to_pylist()
            for texts in batches_of(batch.column("text")):
                own = names[at : at + len(texts)]
                at += len(texts)
                rows = [rearrange(t, numbers_of(seed, d), units) for d, t in zip(own, texts, strict=True)]
                columns = [own, *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. No mark is in a text that was cut, and none
    can arise where two parts meet, so that the marks are where the output was put together."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text by code points, with digests of the output and of the text restored from it."""
    done = fill_in_middle(read_table(spark, sf_dir, "documents"))
    output, back = F.sha2("output", 256), F.sha2(restored(F.col("output"), F.col("form")), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output_sha256"), back.alias("restored_sha256"))


_group = "CAST(concat('0x', substr(sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))), {}, 8)) AS BIGINT)"
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, {", ".join(f"{_group.format(8 * k - 7)} AS h{k}" for k in (1, 2, 3, 4))} FROM documents
), cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), part AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut
) SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256 FROM part"""
