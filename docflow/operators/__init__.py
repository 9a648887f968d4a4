"""DataFrame operators: pages, chunks, ingest rules, retrieval, catalog."""
