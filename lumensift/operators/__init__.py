"""Index, retrieval, presentation, suggestion, facets, catalogue, retrieval contexts."""
