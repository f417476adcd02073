"""Readers and writers on small files."""

import json

import numpy as np

from kinspan.sources import files, pedigree
from kinspan.streaming.recombination_stream import event_sessions

PED = "f1\tm.1\t0\t0\t2\t1\nf1\tp1\t0\t0\t1\t1\nf1\tc1\tp1\tm.1\t1\t2\nf1\tc2\tp1\tm.1\t2\t1\nbad line\n"


def test_pedigree(spark, tmp_path):
    (tmp_path / "a.ped").write_text(PED)
    rows = pedigree.read_pedigree(spark, str(tmp_path / "a.ped"))
    assert {r.individual for r in rows.collect()} == {"m_1", "p1", "c1", "c2"}
    family = pedigree.nuclear_families(rows).collect()[0]
    assert (family.mother, family.father, list(family.children)) == ("m_1", "p1", ["c1", "c2"])
    samples = spark.createDataFrame([("m_1",), ("c1",)], "sample string")
    assert {r.individual for r in pedigree.prune(rows, samples).collect()} == {"m_1", "p1", "c1"}
    assert [r.individual for r in pedigree.missing_parent(rows, samples).collect()] == ["c1"]
    assert pedigree.quads(rows).count() == 2
    pedigree.write_pedigree(rows, str(tmp_path / "out"))
    again = pedigree.read_pedigree(spark, str(tmp_path / "out"))
    assert sorted(again.collect()) == sorted(rows.collect())


def test_genotype_matrices(spark, tmp_path):
    (tmp_path / "samples.json").write_text(json.dumps(["a", "b"]))
    np.savez(tmp_path / "chr.1.0.gen.npz", format=np.array(b"csc"), shape=np.array([2, 3]), data=np.array([1, 2, -2], np.int8), indices=np.array([0, 1, 0]), indptr=np.array([0, 1, 2, 3]))
    np.save(tmp_path / "chr.1.0.gen.coordinates.npy", np.array([[1, 100, 1, 1], [1, 101, 1, 0], [1, 105, 0, 1]]))
    cells, sites = files.read_genotype_matrices(spark, str(tmp_path)), files.read_site_arrays(spark, str(tmp_path))
    table = files.genotype_table(cells, sites, files.read_samples(spark, str(tmp_path / "samples.json")))
    assert sorted(map(tuple, table.collect())) == [("1", 100, "a", 1), ("1", 101, "b", 2), ("1", 105, "a", -1)]


def test_vcf(spark, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2", "chr2\t7\t.\tA\tG\t.\tPASS\tAF=0.5;DB\tGT:DP\t0/1:12\t./.:.", "2\t9\t.\tC\tT\t.\tq\tAF=1\tDP:GT\t3:1|1\t0:0/0"]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    calls = {(r.pos, r["sample"]): (r.gt, r.dp, r.info["AF"]) for r in files.read_vcf(spark, str(tmp_path / "a.vcf")).collect()}
    assert calls == {(7, "s1"): (1, 12, "0.5"), (7, "s2"): (-1, None, "0.5"), (9, "s1"): (2, 3, "1"), (9, "s2"): (0, 0, "1")}
    cells = files.depth_cells(files.read_vcf(spark, str(tmp_path / "a.vcf")), 5)
    assert sorted((r.pos, r["sample"], r.dp) for r in cells.collect()) == [(7, "s2", -1), (9, "s1", 4), (9, "s2", 1)]


def test_phase_bed_and_profiles(spark, tmp_path):
    (tmp_path / "f1.phased.bed").write_text("#chrom\tchrom_start\tchrom_end\tm1_del\tm2_del\tp1_del\tp2_del\tc1_mat\tc1_pat\tloss_region\nchr1\t1\t50\t1\t0\t-1\t1\t0\t2\t0\nchr2\t1\t9\t1\t1\t1\t1\t1\t-1\t1\n")
    rows = files.read_phase_bed(spark, str(tmp_path), ["1"]).collect()
    assert len(rows) == 1 and rows[0].family == "f1" and list(rows[0].dels) == [1, 0, None, 1]
    assert [tuple(x) for x in rows[0].phases] == [("c1", 0, 2)]
    for k in (0, 1):
        (tmp_path / f"e{k}.json").write_text(json.dumps({"a": {"-log10(P[obs=0/1|true_gen=0/0])": 3.0}, **({"b": {"-log10(P[obs=0/1|true_gen=0/0])": 2.0}} if k else {})}))
    profiles = files.read_error_profiles(spark, [str(tmp_path / f"e{k}.json") for k in (0, 1)]).collect()
    assert {(r.individual, r.region, r.true_gt, r.obs_gt, r.cost) for r in profiles} == {("a", 0, "0/0", "0/1", 3.0), ("a", 1, "0/0", "0/1", 3.0)}


def test_fasta_and_frequencies(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 x\nACG\nTTA\n>chr2\nggg\n")
    positions = spark.createDataFrame([("1", 4), ("2", 1)], "chrom string, pos int")
    assert {tuple(r) for r in files.read_fasta_bases(spark, str(tmp_path / "g.fa"), positions).collect()} == {("1", 4, "T"), ("2", 1, "G")}
    sites = spark.createDataFrame([("1", 1, "A", "C"), ("1", 2, "T", "G"), ("1", 3, "T", "G")], "chrom string, pos int, ref string, alt string")
    known = spark.createDataFrame([("1", 1, "A", "C", 0.25), ("1", 2, "G", "T", 0.25)], "chrom string, pos int, ref string, alt string, af double")
    assert {r.pos: r.af for r in files.swapped_frequencies(sites, known).collect()} == {1: 0.25, 2: 0.75, 3: 0.0}


def test_sessions_on_a_stream_equal_the_batch(spark, tmp_path):
    data = spark.createDataFrame([("f", "2024-01-01 00:00:00"), ("f", "2024-01-01 00:30:00"), ("f", "2024-01-01 03:00:00"), ("g", "2024-01-01 00:00:00")], "family string, t string").selectExpr("family", "cast(t as timestamp) as ts")
    data.write.parquet(str(tmp_path / "in"))
    batch = event_sessions(data, "1 hour", "10 minutes", ["family"])
    stream = event_sessions(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "1 hour", "10 minutes", ["family"])
    job = stream.writeStream.format("memory").queryName("found_sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    job.awaitTermination(120)
    assert sorted(map(str, spark.table("found_sessions").collect())) == sorted(map(str, batch.collect()))


def test_several_vcf_files_keep_their_own_samples(spark, tmp_path):
    for k, name in enumerate(("s1", "s2")):
        (tmp_path / f"{name}.vcf").write_text(f"##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{name}\nchr1\t{k}\t.\tA\tG\t.\tPASS\tAF=0.5\tGT:DP\t0/1:{200 * k}\n")
    calls = files.read_vcf(spark, str(tmp_path))
    assert {(r["sample"], r.pos, r.gt) for r in calls.collect()} == {("s1", 0, 1), ("s2", 1, 1)}
    depths, failed = files.capped_depths(calls)
    assert sorted(r.dp for r in depths.collect()) == [0, 100] and [r.n_failed for r in failed.collect()] == [0, 0]


def test_phase_bed_round_trip(spark, tmp_path):
    for family in ("f1", "f 2+x%"):
        (tmp_path / f"{family}.phased.bed").write_text("#chrom\tchrom_start\tchrom_end\tm1_del\tm2_del\tp1_del\tp2_del\tc1_mat\tc1_pat\tx_mat_mat\tx_mat_pat\tloss_region\nchr1\t1\t50\t1\t0\t-1\t1\t0\t2\t1\t3\t0\nchr1\t50\t90\t1\t1\t1\t1\t1\t-1\t-1\t2\t-1\n")
    rows = files.read_phase_bed(spark, str(tmp_path))
    files.write_phase_bed(rows, str(tmp_path / "out" / "bed"))
    again = files.read_phase_bed(spark, str(tmp_path / "out" / "bed"))
    columns = rows.columns
    assert rows.count() == 4 and sorted(map(str, again.select(*columns).collect())) == sorted(map(str, rows.collect()))


def test_variants_frequencies_and_arrays(spark, tmp_path):
    (tmp_path / "v.txt").write_text("chr1\t5\t.\tA\tC\t.\tPASS\tAF=0.25;DB\tGT\n1\t9\t.\tA\tC,G\t.\tPASS\tAF=0.1,0.2\tGT\n2\t5\t.\tA\tC\t.\tPASS\tAF=1\tGT\n")
    variants = files.read_variants(spark, str(tmp_path / "v.txt"))
    assert {(r.pos, r.af) for r in files.frequencies_in_range(variants, "chr1", 5, 9).collect()} == {(5, 0.25), (9, None)}
    (tmp_path / "a.txt").write_text("# comment\nrs1\t1\t5\tAC\nrs2\t1\t6\t--\nrs3\t1\t7\tGG\n")
    reference = spark.createDataFrame([("1", 5, "A"), ("1", 6, "A"), ("1", 7, "A")], "chrom string, pos int, base string")
    assert {(r.rsid, r.gt) for r in files.read_array_genotypes(spark, str(tmp_path / "a.txt"), reference).collect()} == {("rs1", 1), ("rs2", -1), ("rs3", 2)}
    keyed = files.keyed_variants(spark.createDataFrame([("1_1000_A_G_b38",)], "key string"), "key").first()
    assert (keyed.chrom, keyed.pos, keyed.ref, keyed.alt, keyed.build) == ("1", 1000, "A", "G", "b38")
    known = files.with_frequencies(spark.createDataFrame([("1", 5), ("1", 8)], "chrom string, pos int"), files.frequencies_in_range(variants, "1", 1, 9))
    assert {(r.pos, r.af) for r in known.collect()} == {(5, 0.25), (8, None)}


def test_lists_logs_and_tables(spark, tmp_path):
    (tmp_path / "families.txt").write_text("family\tmembers\nf1\ta\tb\tc\nf2\td\te\n")
    assert {(r.family, tuple(r.members)) for r in files.read_family_list(spark, str(tmp_path / "families.txt")).collect()} == {("f1", ("a", "b", "c")), ("f2", ("d", "e"))}
    (tmp_path / "t.txt").write_text("chrom\tstart\tend\tk.1\tk2\nchr1\t1\t5\tAC\tBD\nchr1\t5\t9\tAD\tBD\n")
    assert [(r.start_pos, list(r.letters)) for r in files.read_transmissions(spark, str(tmp_path / "t.txt")).orderBy("start_pos").collect()] == [(1, ["AC", "BD"]), (5, ["AD", "BD"])]
    (tmp_path / "run.log").write_text("x\nForward sweep complete 30.9 sec\nBackward sweep complete in 64.4 sec\n")
    assert {(r.sweep, r.seconds) for r in files.read_runtimes(spark, str(tmp_path / "run.log")).collect()} == {("Forward", 30.9), ("Backward", 64.4)}
    folder = tmp_path / "phases"
    folder.mkdir()
    for name in ("a.phased.bed", "a.info.json", "b.phased.bed", "c.info.json"):
        (folder / name).write_text("{}")
    assert [r.family for r in files.phased_families(spark, str(folder)).collect()] == ["a"]
    files.write_run_info(spark, {"assembly": "38", "deletion": 1.5}, str(tmp_path / "info"))
    assert spark.read.json(str(tmp_path / "info")).first().asDict() == {"assembly": "38", "deletion": "1.5"}
    files.write_denovo(spark.createDataFrame([(1, "c")], "pos int, child string"), str(tmp_path / "denovo"))
    assert spark.read.text(str(tmp_path / "denovo")).first().value == "c\t1"


def test_bases_of_long_sequences(spark, tmp_path):
    sequence = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(1000))
    (tmp_path / "g.fa").write_text(">chr1 x\n" + "\n".join(sequence[i : i + 60] for i in range(0, 1000, 60)) + "\n")
    asked = spark.createDataFrame([("1", p) for p in (1, 16, 17, 64, 65, 1000, 1001)], "chrom string, pos int")
    found = {r.pos: r.base for r in files.read_fasta_bases(spark, str(tmp_path / "g.fa"), asked, block=16).collect()}
    assert {p: b for p, b in found.items() if p <= 1000} == {p: sequence[p - 1] for p in (1, 16, 17, 64, 65, 1000)} and not found.get(1001)


def test_family_helpers(spark, tmp_path):
    (tmp_path / "a.ped").write_text(PED + "f3\tz1\t0\t0\t1\t1\n")
    rows = pedigree.read_pedigree(spark, str(tmp_path / "a.ped"))
    assert {r.family for r in pedigree.with_descendants(rows).collect()} == {"f1"}
    assert {(r.individual, r.sex) for r in pedigree.attributes(rows).collect()} >= {("c1", "1"), ("c2", "2")}
    kids = spark.createDataFrame([("f", str(i), "2" if i < 3 else "1") for i in range(6)] + [("g", "9", "1")], "family string, individual string, phenotype string")
    pairs = pedigree.disjoint_pairs(kids).collect()
    assert len(pairs) == 3 and sum(r.phenotype is None for r in pairs) == 1 and len({x for r in pairs for x in (r.sibling1, r.sibling2)}) == 6
    order = pedigree.shuffled_children(rows, 3).collect()
    assert sorted(r.child_order for r in order) == [0, 1]
