"""codeloom: retrieval and program-graph analytics over Spark tables of a code index."""
