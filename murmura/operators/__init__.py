"""DataFrame operators: enrichment, counters, ranking, graph, vectors."""
