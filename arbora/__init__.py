"""arbora: rooted trajectory trees from embeddings, groups and a scalar stage, on Spark."""
