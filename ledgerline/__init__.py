"""ledgerline: versioned-registry analytics on Spark DataFrames."""
