"""Record-linkage, graph and event operators on DataFrames."""
