"""Near-duplicate classes by BagMinHash (weighted Jaccard of word-shingle multisets).

A text is the multiset of its five-word shingles; the likeness of two texts is
the weighted Jaccard index, sum of minima over sum of maxima of the counts.
Each shingle carries Poisson processes over discretised weights: the levels
1, 2-3, 4-7, ... form blocks, block b has rate 2**b per signature component, and
every point of a block falls on one component and one level of the block. A text
that holds the shingle ``w`` times sees the points with level <= w. Component i
of the signature is the first point that the text sees there, so that two texts
agree on it with a probability equal to their weighted Jaccard index.

Points are made only up to a time at which all components have been hit with
high probability; texts with a component left go on with twice the time, so
that signatures are exact.

Then: signatures are cut into bands, texts that share a band are candidates,
and candidates are verified on their multisets. Texts need never be listed in
all pairs: every text is first tried against the centre of its bands, verified
links form classes, and after that only pairs across classes remain to be tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, written
from .words import as_bytes, chunks, mix, ranges, shingles, words_of

COMPONENTS = 256
ROWS = 8
BANDS = COMPONENTS // ROWS
LONGS = COMPONENTS // 64
SIMILARITY = 0.8
#: A bit of each component is kept beside the bands. Unequal components differ in
#: it half the time, so that texts of likeness J differ in (1 - J) / 2 of the bits.
#: Candidates that differ in more than MOST_UNEQUAL bits are not verified. A pair at a
#: likeness of 0.8 differs in 25.6 bits on average, and in more than 72 (which stand for
#: a likeness below 0.44) with a probability below 1e-14. With COMPONENTS every
#: candidate is verified.
MOST_UNEQUAL = 72
#: Centres that each band is tried against before its classes are compared.
CENTRES = 3
#: Bytes of the texts of a bucket that one task compares with as many others.
BLOCK_BYTES = 8 << 20
#: What a text takes beside its bytes.
ROW_BYTES = 512
#: Shingles of pairs that are compared at once.
PAIR_ELEMENTS = 1 << 20
#: 50 bits of a shingle's hash beside 14 bits of the text's number in its chunk.
SHINGLE_BITS = 50


def weighted_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a chunk: its number, its shingles (50 bits), their counts."""
    hashes, counts = shingles(words_of(data, offsets))
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort((text << np.uint64(SHINGLE_BITS)) | (hashes >> np.uint64(64 - SHINGLE_BITS)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    weights = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> np.uint64(SHINGLE_BITS)).astype(np.int64), keys & np.uint64((1 << SHINGLE_BITS) - 1), weights


def signatures(texts: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n, m) times of first points; texts without elements keep infinity."""
    out = np.full((n, m), np.inf)
    if not len(texts):
        return out
    blocks = np.frexp(weights.astype(float))[1]  # a weight w reaches into blocks 0 .. floor(log2 w)
    block = ranges(blocks)
    row_text, row_weight = np.repeat(texts, blocks), np.repeat(weights, blocks)
    seed = mix(np.repeat(elements, blocks) * np.uint64(64) + block.astype(np.uint64))
    size = np.left_shift(1, block)
    mass = np.bincount(texts, weights, n)
    open_texts, factor = mass > 0, 1.0
    while open_texts.any():
        limit = np.zeros(n)
        np.divide(factor * (np.log(m) + 6.0), mass, out=limit, where=open_texts)
        live = np.flatnonzero(open_texts[row_text])
        text, weight, width, low, stream = row_text[live], row_weight[live], size[live], size[live], seed[live]
        time, bound = np.zeros(len(live)), limit[text]
        out[open_texts] = np.inf
        flat = out.reshape(-1)
        while len(text):
            stream = mix(stream)
            time = time - np.log1p(-(stream >> np.uint64(11)).astype(float) * 2.0**-53) / (width * float(m))
            go = time < bound
            if not go.all():
                text, weight, width, low, stream, time, bound = (x[go] for x in (text, weight, width, low, stream, time, bound))
                if not len(text):
                    break
            where = mix(stream ^ np.uint64(0xD6E8FEB86659FD93))
            component = (where & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
            level = low + ((where >> np.uint64(32)).astype(np.int64) & (width - 1))
            seen = level <= weight
            np.minimum.at(flat, (text * m + component)[seen], time[seen])
        open_texts = open_texts & np.isinf(out).any(axis=1)
        factor *= 2
    return out


def _codes(times: np.ndarray) -> np.ndarray:
    return mix(np.ascontiguousarray(times).view(np.uint64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, bands array<long>, bits array<long>: a bit of each component, bytes)."""
    seeds = mix(np.arange(COMPONENTS, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        for at, to, data, offsets in chunks(batch.column("text")):
            n = to - at
            step = 1 << (64 - SHINGLE_BITS)
            for lo in range(0, n, step):
                hi = min(n, lo + step)
                part, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                codes = _codes(signatures(*weighted_shingles(part, cut), hi - lo))
                bands = mix((codes * seeds).reshape(hi - lo, BANDS, ROWS).sum(axis=2, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at + lo, hi - lo),
                        pa.ListArray.from_arrays(np.arange(0, (hi - lo) * BANDS + 1, BANDS, dtype=np.int32), bands.view(np.int64).reshape(-1)),
                        pa.ListArray.from_arrays(np.arange(0, (hi - lo) * LONGS + 1, LONGS, dtype=np.int32), np.packbits((codes & np.uint64(1)).astype(bool), axis=1).view(np.int64).reshape(-1)),
                        pa.array(np.diff(cut)),
                    ],
                    ["id", "bands", "bits", "size"],
                )


class Multisets:
    """Weighted shingles of some texts, to be compared in pairs."""

    def __init__(self, column: pa.Array):
        data, offsets = as_bytes(column)
        texts, self.elements, self.weights = weighted_shingles(data, offsets)
        self.first = np.searchsorted(texts, np.arange(len(offsets)))

    def _flat(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.first[texts + 1] - self.first[texts]
        at = np.repeat(self.first[texts], counts) + ranges(counts)
        pair = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
        return (pair << np.uint64(SHINGLE_BITS)) | self.elements[at], self.weights[at]

    def likeness(self, one: np.ndarray, other: Multisets, two: np.ndarray) -> np.ndarray:
        """Weighted Jaccard index of the texts ``one`` of this and ``two`` of the other."""
        out = np.zeros(len(one))
        size = np.cumsum((self.first[one + 1] - self.first[one]) + (other.first[two + 1] - other.first[two]))
        at = 0
        while at < len(one):
            done = size[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(size, done + PAIR_ELEMENTS, "right"))), at + (1 << (64 - SHINGLE_BITS)))
            sides = self._flat(one[at:to]), other._flat(two[at:to])
            keys, weights = (np.concatenate([x[k] for x in sides]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
            pair = (keys >> np.uint64(SHINGLE_BITS)).astype(np.int64)
            both = np.flatnonzero(keys[1:] == keys[:-1])
            common = np.bincount(pair[both], np.minimum(weights[both], weights[both + 1]), to - at)
            out[at:to] = common / np.maximum(np.bincount(pair, weights, to - at) - common, 1)
            at = to
        return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b, likeness) of the pairs at SIMILARITY or more."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            every = np.arange(part.num_rows)
            likeness = Multisets(part.column("text_a")).likeness(every, Multisets(part.column("text_b")), every)
            keep = pa.array(np.flatnonzero(likeness >= SIMILARITY))
            yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep), pa.array(likeness[likeness >= SIMILARITY])], ["a", "b", "likeness"])


def _links_of_bucket(key: tuple, bucket: pa.Table, most_unequal: int) -> pa.Table:
    """Links between the classes of a band's bucket, of pairs that agree enough and
    share no earlier band; of two blocks of a large bucket, the pairs across them."""
    band, blocks = key[0].as_py(), (key[2].as_py(), key[3].as_py())
    bucket = bucket.combine_chunks()
    root, own = bucket["root"].to_numpy(), bucket["own"].to_numpy()
    bits, bands = (np.array(bucket[c].to_pylist(), np.int64).reshape(bucket.num_rows, -1) for c in ("bits", "bands"))
    one, two = [], []
    for x in range(bucket.num_rows - 1):
        rest = np.arange(x + 1, bucket.num_rows)
        rest = rest[(root[rest] != root[x]) & ((blocks[0] == blocks[1]) | (own[rest] != own[x]))]
        rest = rest[np.bitwise_count((bits[rest] ^ bits[x]).view(np.uint64)).sum(axis=1) <= most_unequal]
        rest = rest[(bands[rest, :band] != bands[x, :band]).all(axis=1)]
        one.append(np.full(len(rest), x))
        two.append(rest)
    ids = bucket["id"].to_numpy()
    one, two = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two))
    if len(one):
        texts = Multisets(bucket["text"].combine_chunks())
        keep = texts.likeness(one, texts, two) >= SIMILARITY
        one, two = one[keep], two[keep]
    return pa.table({"a": np.maximum(ids[one], ids[two]), "b": np.minimum(ids[one], ids[two])})


def _unequal(one: str, two: str) -> Column:
    """Bits in which two signatures differ."""
    return reduce(add, (F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(LONGS)))


def _agreeing(pairs: DataFrame, bits: DataFrame, most_unequal: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough, and in how many bits they don't."""
    one = bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a"))
    two = bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", _unequal("bits_a", "bits_b").alias("unequal")).where(F.col("unequal") <= most_unequal)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a likeness of SIMILARITY or more."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(_verify, "a long, b long, likeness double")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of ``links(a, b)`` reaches.

    Alternates large-star and small-star steps, each a grouping by node, until
    no link changes; a step's links are written before the next one.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark = now


def _apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs that no chain of verified links joins yet."""
    pairs = pairs.join(root.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a", "left")
    pairs = pairs.join(root.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b", "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _across(shared: DataFrame, signed: DataFrame, texts: DataFrame, root: DataFrame, most_unequal: int) -> DataFrame:
    """Links between texts that share a band but are of two classes so far.

    A bucket is compared within one task, without its pairs becoming rows; one with more
    than BLOCK_BYTES of texts is dealt into blocks, and every two blocks are compared in
    a task.
    """
    sized = signed.join(root, "id", "left").select("id", "size", F.coalesce("root", "id").alias("root"))
    named = shared.select("band", "value", "id").join(sized, "id")
    mixed = named.groupBy("band", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.col("size") + ROW_BYTES).alias("bytes")).where("lo < hi")
    mixed = mixed.select("band", "value", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("blocks"))
    named = named.drop("size").join(mixed, ["band", "value"]).join(signed.select("id", "bands", "bits"), "id").join(texts, "id")
    named = named.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = named.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    rows = named.select("band", "value", "lo", "hi", "id", "root", "own", "bits", "bands", "text")


    def links(key: tuple, bucket: pa.Table) -> pa.Table:
        return _links_of_bucket(key, bucket, most_unequal)

    return rows.groupBy("band", "value", "lo", "hi").applyInArrow(links, "a long, b long")


def _stars(shared: DataFrame, signed: DataFrame, k: int, most_unequal: int) -> DataFrame:
    """Each text with the k-th centres of its bands, if they agree enough."""
    centre = f"centre_{k}"
    pairs = shared.where(F.col("id") != F.col(centre)).select(F.greatest("id", centre).alias("a"), F.least("id", centre).alias("b")).distinct()
    return written(_agreeing(pairs, signed.select("id", "bits"), most_unequal), "stars")


def _classes(exact: DataFrame, rows: DataFrame, most_unequal: int) -> DataFrame:
    """(id, root) of the different texts that have a near duplicate among the others."""
    signed = rows.select("id", "text").mapInArrow(_sign, "id long, bands array<long>, bits array<long>, size long")
    signed = written(signed.dropDuplicates(["id"]), "signed")
    buckets = signed.select("id", F.posexplode("bands").alias("band", "value"))
    # The order of centres is the same in all bands: the bands of a large class have few
    # different centres among them, and a text meets its class a few times, not once a band.
    picked = [F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"centre_{k}") for k in range(CENTRES)]
    centres = buckets.groupBy("band", "value").agg(F.count("*").alias("n"), *picked).where("n > 1").drop("n")
    shared = written(buckets.join(centres, ["band", "value"]), "buckets")
    wanted = shared.select("id").distinct().join(exact, "id").select("id", F.col("least").alias("doc"))
    same = (rows["id"] == wanted["id"]) & rows["doc"].eqNullSafe(wanted["doc"])
    texts = written(rows.join(wanted, same).select(rows["id"], rows["doc"], "text").dropDuplicates(["id", "doc"]).select("id", "text"), "texts")

    stars = _stars(shared, signed, 0, most_unequal)
    # First each text with the centre that it agrees with most, then what this leaves apart.
    root = components(verified(stars.groupBy("a").agg(F.min_by("b", "unequal").alias("b")), texts))
    tried = stars.select("a", "b")
    root = _joined(root, verified(_apart(tried, root), texts))
    for k in range(1, CENTRES):
        more = _stars(shared, signed, k, most_unequal).select("a", "b")
        root = _joined(root, verified(_apart(more.join(tried, ["a", "b"], "left_anti"), root), texts))
        tried = tried.union(more)
    return _joined(root, _across(shared, signed, texts, root, most_unequal))


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    return components(root.select(F.col("id").alias("a"), F.col("root").alias("b")).union(links.select("a", "b")))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_unequal: int = MOST_UNEQUAL) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the least id of its class), class_size.

    Null text counts as empty; empty texts (and texts of white space only, which
    have no shingle) are a class only with texts equal to them. A row that repeats
    an id, or has none, gets the class of its text; class_id is null where no row
    of the class has an id. Texts of any length are compared whole; an empty table
    gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.xxhash64(F.sha2("text", 256)))
    keyed = written(rows.select("doc", "id"), "keyed")
    exact = keyed.groupBy("id").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    named = exact.join(_classes(exact, rows, most_unequal), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = named.join(classes, "root").select("id", "class_id", "class_size")
    return keyed.join(named, "id").select(F.col("doc").alias(id_col), "class_id", "class_size")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def keep_first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the near duplicates of a row with a lesser doc_id, and
    without rows that repeat a doc_id and its text. Rows without doc_id stay."""
    gone = near_duplicate_classes(docs).where("doc_id <> class_id").select("doc_id").distinct()
    left = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return left.unionByName(docs.where("doc_id is null"))
