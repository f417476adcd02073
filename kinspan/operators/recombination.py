"""Recombinations, crossovers and gene conversions from phased segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MATERNAL_CUTOFF, PATERNAL_CUTOFF
from ..functions.intervals import islands, last_known, sweep

TRACK = ["family", "chrom"]


def masked(phase: Column, is_hard: Column) -> Column:
    """Phase as null where it is unknown (-1) or the segment is hard to sequence."""
    return F.when((phase >= 0) & ~is_hard, phase)


def recombinations(segments: DataFrame, phase: str, keys: list[str] = TRACK, hard: str = "is_hard") -> DataFrame:
    """Changes between successive known phases of a track.

    ``segments`` has start_pos, end_pos, seg_id, the phase column (null: unknown)
    and the flag of hard-to-sequence segments. A change lies between the last base
    of the known segment before (end - 1) and the start of the one after; is_hts
    says whether a hard segment lies between them.
    """
    over = Window.partitionBy(*keys).orderBy("start_pos", "seg_id")
    counted = segments.withColumn("_hard", F.sum(F.col(hard).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    known = counted.where(F.col(phase).isNotNull())
    before = known.select(*keys, "start_pos", phase, "_hard", *[F.lag(c).over(over).alias(f"_{c}_before") for c in (phase, "end_pos", "_hard")])
    changed = before.where(F.col(phase) != F.col(f"_{phase}_before"))
    return changed.select(*keys, (F.col("_end_pos_before") - 1).alias("start_pos"), F.col("start_pos").alias("end_pos"), (F.col("_hard") > F.col("__hard_before")).alias("is_hts"))


def by_side(segments: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Segments once for the maternal and once for the paternal track: is_mat and phase, so
    that both are read, dealt and sorted together."""
    sides = F.explode(F.array(F.struct(F.lit(True).alias("is_mat"), F.col("mat_phase").alias("phase")), F.struct(F.lit(False).alias("is_mat"), F.col("pat_phase").alias("phase"))))
    return segments.select(*keys, "start_pos", "end_pos", "seg_id", "is_hard", sides.alias("_s")).select("*", "_s.*").drop("_s")


def events(found: DataFrame, cutoff: int | Column, keys: list[str] = TRACK) -> DataFrame:
    """Recombinations at most ``cutoff`` apart as one event.

    An even number is a gene conversion (complex above two), an odd number a
    crossover (complex above one); the recombinations stay nested in the event.
    """
    over = Window.partitionBy(*keys).orderBy("start_pos", "end_pos")
    apart = F.col("start_pos") - F.col("_end_before") > cutoff
    dealt = islands(found.withColumn("_end_before", F.lag("end_pos").over(over)), keys, ["start_pos", "end_pos"], apart)
    whole = dealt.groupBy(*keys, "island").agg(
        F.min("start_pos").alias("start_pos"),
        F.max("end_pos").alias("end_pos"),
        F.count("*").alias("n_recombinations"),
        F.bool_or("is_hts").alias("is_hts"),
        F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "is_hts"))).alias("recombinations"),
    )
    even = F.col("n_recombinations") % 2 == 0
    return whole.select(*keys, "start_pos", "end_pos", "n_recombinations", even.alias("is_gene_conversion"), F.when(even, F.col("n_recombinations") > 2).otherwise(F.col("n_recombinations") > 1).alias("is_complex"), "is_hts", "recombinations")


def both_sides(segments: DataFrame, maternal_cutoff: int = MATERNAL_CUTOFF, paternal_cutoff: int = PATERNAL_CUTOFF, keys: list[str] = TRACK) -> DataFrame:
    """Events of the maternal (mat_phase) and paternal (pat_phase) track, with is_mat."""
    cutoff = F.when(F.col("is_mat"), maternal_cutoff).otherwise(paternal_cutoff)
    return events(recombinations(by_side(segments, keys), "phase", [*keys, "is_mat"]), cutoff, [*keys, "is_mat"])


def crossover_counts(found: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Crossovers of each owner and side; owners without any have zeros."""
    crossovers = found.where("not is_gene_conversion").groupBy(*keys).agg(F.count_if("is_mat").alias("maternal_crossovers"), F.count_if(~F.col("is_mat")).alias("paternal_crossovers"))
    return owners.join(crossovers, keys, "left").na.fill(0, ["maternal_crossovers", "paternal_crossovers"])


def switch_smoothing(found: DataFrame, least_run: int, keys: list[str]) -> DataFrame:
    """Crossovers of phase tracks (keys, pos, phase) once runs shorter than ``least_run``
    positions are dropped: an odd number of dropped runs flips nothing between equal
    flanks, so the switches left are those between successive kept runs that differ."""
    over = Window.partitionBy(*keys).orderBy("pos")
    runs = islands(found.withColumn("_before", F.lag("phase").over(over)), keys, ["pos"], F.col("phase") != F.col("_before"), "run")
    runs = runs.groupBy(*keys, "run").agg(F.first("phase").alias("phase"), F.min("pos").alias("pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).where(F.col("n") >= least_run)
    kept = runs.select(*keys, "phase", "pos", "last_pos", F.lag("phase").over(over).alias("phase_before"), F.lag("last_pos").over(over).alias("start_pos"))
    return kept.where("phase <> phase_before").select(*keys, "start_pos", F.col("pos").alias("end_pos"))


def known_state_changes(track: DataFrame, keys: list[str], state: str, width: int) -> DataFrame:
    """Changes between successive known states: start_pos is where the last one was known to
    end, end_pos where the next one begins; before and after are the states.

    A known state goes on over unknown segments, and each segment with it moves its end on.
    What is known last is handed from range to range of the axis.
    """
    found = last_known(track, keys, state, width).where(F.col(state) != F.col("before_value"))
    return found.select(*keys, F.col("before_end").alias("start_pos"), F.col("start_pos").alias("end_pos"), F.col("before_value").alias("before"), F.col(state).alias("after"))


def spread_evenly(changes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Expected changes in each elementary interval of the axis (``keys``): each change counts
    as one, spread over its bases; weight is the sum of the parts that fall there.

    Changes without bases (where the next state begins at the last one's end) have no place
    and are left out. One sweep of densities; no pairs of changes and intervals are made.
    """
    placed = changes.where("end_pos > start_pos")
    density = 1 / (F.col("end_pos") - F.col("start_pos"))
    tiles = sweep(placed, keys, {"n": F.lit(1), "density": density}, width)
    return tiles.where("n > 0").select(*keys, "start_pos", "end_pos", "n", (F.col("density") * (F.col("end_pos") - F.col("start_pos"))).alias("weight"))
