"""helixlake: exact k-mer analytics over sequence collections on Spark DataFrames."""
