"""The registered queries over the ledger that the driver's tables stand for, and their SQL."""

from ledgerscope.plans import queries_amounts, queries_clusters, queries_graph, queries_ledger, queries_matching, queries_stream, queries_trace

QUERIES = {**queries_ledger.QUERIES, **queries_clusters.QUERIES, **queries_graph.QUERIES, **queries_trace.QUERIES, **queries_amounts.QUERIES, **queries_matching.QUERIES, **queries_stream.QUERIES}
SQL = {**queries_ledger.SQL, **queries_clusters.SQL, **queries_graph.SQL, **queries_trace.SQL, **queries_amounts.SQL, **queries_matching.SQL, **queries_stream.SQL}
