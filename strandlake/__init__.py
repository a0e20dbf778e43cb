"""Genotype and haplotype analytics on Spark DataFrames."""
