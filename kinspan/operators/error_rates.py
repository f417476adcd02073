"""Error profiles from families whose inheritance is known.

A member's ``mask`` has a bit for each of the couple's four haplotypes (1, 2: the mother's,
4, 8: the father's) that it carries. A configuration says which of the four carry the other
allele; under it a member's true genotype is the number of its haplotypes that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import settled

#: Genotypes by their code; -1 is a call that wasn't made.
GENOTYPES = ("0/0", "0/1", "1/1")
MISSING = "./."
CONFIGURATIONS = 16


def dosage(mask: Column, configuration: Column | int) -> Column:
    """How many of a member's haplotypes carry the allele under a configuration."""
    return F.bit_count(mask.bitwiseAND(configuration if isinstance(configuration, Column) else F.lit(configuration)))


def true_genotypes(calls: DataFrame, site: list[str]) -> DataFrame:
    """``calls`` (the ``site`` columns, individual, mask, gt and others) with true_gt and n_fits.

    All configurations are scored within the row of a family's site: the number of made calls
    (gt of 0, 1, 2) that differ from what they say. The first one of the fewest differences
    gives the true genotypes, and n_fits is how many have as few. Sites at which a member's
    mask is null are left out. A group is a family at a site.
    """
    rest = [c for c in calls.columns if c not in site]
    grouped = calls.groupBy(*site).agg(F.collect_list(F.struct(*rest)).alias("_members")).where(~F.exists("_members", lambda m: m.mask.isNull()))
    unlike = lambda a: F.size(F.filter("_members", lambda m: (m.gt >= 0) & (dosage(m.mask, a) != m.gt)))
    scored = grouped.withColumn("_unlike", F.transform(F.sequence(F.lit(0), F.lit(CONFIGURATIONS - 1)), unlike))
    least = F.array_min("_unlike")
    best = scored.withColumns({"_best": (F.array_position("_unlike", least) - 1).cast("int"), "n_fits": F.size(F.filter("_unlike", lambda n: n == least))})
    rows = best.select(*site, "_best", "n_fits", F.explode("_members").alias("_m")).select(*site, "_best", "n_fits", "_m.*")
    return rows.withColumn("true_gt", dosage(F.col("mask"), F.col("_best"))).drop("_best")


def confusion(found: DataFrame) -> DataFrame:
    """(individual, region, true_gt, gt, weight): calls of each kind, each counting one over
    the number of configurations that fit its site as well."""
    return found.groupBy("individual", "region", "true_gt", "gt").agg(F.sum(1 / F.col("n_fits")).alias("weight"))


def error_profiles(counts: DataFrame) -> DataFrame:
    """Profiles as read_error_profiles gives them: individual, region, true_gt, obs_gt, cost.

    A cost is -log10 of the share of an observed genotype among the made calls of a true one.
    That of an unmade call is taken over all true genotypes, and a pair that an individual
    never shows has the share that all individuals together have. What is left of one is
    the share of the right call; it is null where nothing is left or a share is unknown.
    A pair that nobody shows costs infinitely much.
    """
    counts = settled(counts, "confusion")
    wide = counts.groupBy("individual", "region", "true_gt").agg(*[F.sum(F.when(F.col("gt") == g, F.col("weight")).otherwise(0.0)).alias(f"n{g}") for g in (0, 1, 2, -1)])
    # Every true genotype of every individual, seen or not; a few rows an individual.
    people = counts.select("individual", "region").distinct().withColumn("true_gt", F.explode(F.array(*[F.lit(g) for g in (0, 1, 2)])))
    numbers = ["n0", "n1", "n2", "n-1"]
    wide = people.join(wide.withColumn("true_gt", F.col("true_gt").cast("int")), ["individual", "region", "true_gt"], "left").na.fill(0.0, numbers)
    made = F.col("n0") + F.col("n1") + F.col("n2")
    wide = wide.withColumn("made", made)
    own = wide.groupBy("individual", "region").agg(F.sum("n-1").alias("own_missing"), F.sum("made").alias("own_made"))
    # Three rows a region.
    pooled = wide.groupBy("region", "true_gt").agg(*[F.sum(n).alias(f"all_{n}") for n in ("n0", "n1", "n2", "made")])
    both = wide.join(own, ["individual", "region"]).join(F.broadcast(pooled), ["region", "true_gt"])

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole)

    shares = {g: F.when(F.col("true_gt") != g, F.when(F.col(f"n{g}") == 0, share(F.col(f"all_n{g}"), F.col("all_made"))).otherwise(share(F.col(f"n{g}"), F.col("made")))) for g in (0, 1, 2)}
    both = both.withColumns({"_p0": shares[0], "_p1": shares[1], "_p2": shares[2], "_p3": share(F.col("own_missing"), F.col("own_made"))})
    wrong = sum((F.when(F.col("true_gt") == g, F.lit(0.0)).otherwise(F.col(f"_p{g}")) for g in (0, 1, 2)), F.col("_p3"))
    right = F.when(wrong < 1, 1 - wrong)

    def cost(p: Column) -> Column:
        return F.when(p == 0, F.lit(float("inf"))).otherwise(0.0 - F.log10(p))

    calls = [F.struct(F.lit(GENOTYPES[g]).alias("obs_gt"), cost(F.when(F.col("true_gt") == g, right).otherwise(F.col(f"_p{g}"))).alias("cost")) for g in (0, 1, 2)]
    calls.append(F.struct(F.lit(MISSING).alias("obs_gt"), cost(F.col("_p3")).alias("cost")))
    names = F.element_at(F.array(*[F.lit(g) for g in GENOTYPES]), F.col("true_gt") + 1)
    return both.select("individual", "region", names.alias("true_gt"), F.explode(F.array(*calls)).alias("_c")).select("individual", "region", "true_gt", "_c.*")


def write_error_profiles(profiles: DataFrame, path: str, files: int = 1) -> None:
    """Profiles of one region class as JSON objects (individual -> name of a cost -> cost), in
    so many files; costs that are null or infinite are no JSON numbers and are left out."""
    name = F.concat(F.lit("-log10(P[obs="), "obs_gt", F.lit("|true_gen="), "true_gt", F.lit("])"))
    known = profiles.where("cost is not null and cost < double('infinity')")
    people = known.groupBy("individual").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "cost")))).alias("costs"))
    dealt = people.withColumn("part", F.pmod(F.xxhash64("individual"), F.lit(files)))
    objects = dealt.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("individual").cast("string"), "costs")))).alias("value"))
    objects.repartition("part").write.partitionBy("part").text(path)


def consistent_with(mask: Column, is_double: Column) -> Column:
    """The configurations (a bit each) under which a member has two deleted haplotypes
    exactly if it is known to; all of them if something is null."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(CONFIGURATIONS - 1)), lambda a: F.when(F.coalesce((dosage(mask, a) == 2) == is_double, F.lit(True)), F.call_function("shiftleft", F.lit(1), a)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc.bitwiseOR(x))


def zygosity(members: DataFrame, family: list[str]) -> DataFrame:
    """``members`` (``family``, mask, is_double: homozygously deleted) with n_options, zygosity,
    maternal and paternal.

    The configurations that are consistent with all members of the family are the ``and`` of
    the members' bit sets. zygosity is double, single or none if all of them say so, else
    maybe; maternal and paternal are whether the member's haplotypes of that parent are
    deleted: yes, no or maybe, null if it has none. Without a consistent configuration all
    are null. Rows with a null mask or state restrict nothing and have null results.
    """
    bits = members.select(*family, consistent_with(F.col("mask"), F.col("is_double")).alias("_bits"))
    both = members.join(bits.groupBy(*family).agg(F.coalesce(F.bit_and("_bits"), F.lit((1 << CONFIGURATIONS) - 1)).alias("_options")), family)
    left = F.filter(F.sequence(F.lit(0), F.lit(CONFIGURATIONS - 1)), lambda a: F.col("_options").bitwiseAND(F.call_function("shiftleft", F.lit(1), a)) != 0)
    both = both.withColumn("_left", left)

    def agreed(mask: Column) -> tuple[Column, Column]:
        doses = F.transform("_left", lambda a: dosage(mask, a))
        return F.array_min(doses), F.array_max(doses)

    low, high = agreed(F.col("mask"))
    known = F.col("mask").isNotNull() & F.col("is_double").isNotNull() & (F.size("_left") > 0)
    kind = F.when(known, F.when(low != high, "maybe").otherwise(F.element_at(F.array(F.lit("none"), F.lit("single"), F.lit("double")), low + 1)))

    def side(bits: int) -> Column:
        own = F.col("mask").bitwiseAND(F.lit(bits))
        low, high = agreed(own)
        return F.when(known & (own != 0), F.when(low != high, "maybe").when(low > 0, "yes").otherwise("no"))

    return both.select(*members.columns, F.size("_left").alias("n_options"), kind.alias("zygosity"), side(3).alias("maternal"), side(12).alias("paternal"))
