"""Schemas of the domain tables. -1 in files is null in tables."""

from __future__ import annotations

PEDIGREE = "family string, individual string, father string, mother string, sex string, phenotype string"
SITE = "chrom string, pos int, is_snp boolean, is_pass boolean, ref string, alt string"
GENOTYPE = "chrom string, pos int, sample string, gt tinyint"
EMISSION = "individual string, region int, true_gt string, obs_gt string, cost double"
SEGMENT = "family string, chrom string, seg_idx int, start_pos int, end_pos int, dels array<tinyint>, loss_region int"
SEGMENT_PHASE = "family string, chrom string, seg_idx int, individual string, ind_idx int, mat int, pat int"
RECOMBINATION = "family string, chrom string, start_pos bigint, end_pos bigint, is_mat boolean, is_pat boolean, is_hts boolean"
EVENT = f"family string, chrom string, start_pos bigint, end_pos bigint, is_mat boolean, is_pat boolean, is_complex boolean, is_hts boolean, recombinations array<struct<{RECOMBINATION}>>"
DELETION = "family string, chrom string, start_pos bigint, end_pos bigint, length bigint, opt_start_pos bigint, opt_end_pos bigint, trans array<string>, notrans array<string>, is_mat boolean, is_pat boolean, is_hts boolean, parent string"
SIBPAIR = (
    "family string, sibling1 string, sibling2 string, is_fully_phased boolean, maternal_ibd double, paternal_ibd double, matxpat_ibd double, "
    "maternal_unknown_fraction double, paternal_unknown_fraction double, matxpat_unknown_fraction double, "
    "maternal_ibd_chroms array<double>, paternal_ibd_chroms array<double>, matxpat_ibd_chroms array<double>, "
    "is_identical boolean, is_ibd_outlier boolean, maternal_crossovers int, paternal_crossovers int, is_crossover_outlier boolean"
)
REGION = "category string, name string, chrom string, start_pos int, end_pos int"
