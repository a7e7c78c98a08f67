"""Office benchmarking on Spark: linkage, enrichment, page mining, statistics and reports over DataFrames."""
