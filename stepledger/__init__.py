"""Dataset-step operators, table reconciliation and program lineage on Spark DataFrames."""
