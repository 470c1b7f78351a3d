"""End-to-end builds: the dictionary, its documents, and the contract audit."""
