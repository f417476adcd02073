"""Operators on pedigrees, genotypes, phased segments and what is derived from them."""
