"""linkloom: record linkage, graph analytics and derived variables on Spark DataFrames."""
