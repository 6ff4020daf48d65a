"""quern: retrieval, trace, graph and catalog analytics over text and code corpora on Spark."""
