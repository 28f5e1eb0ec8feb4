"""bipartiq: dense-subgraph analytics on large bipartite graphs, written for Spark.

DataFrames carry original vertex ids and stay relational from the scan to the
result; numpy kernels only ever see graphs that a reduction has shrunk below a
checked size.
"""
