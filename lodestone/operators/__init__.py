"""Operators over DataFrames: corpus, index, retrieval, answers, graph, evaluation and state."""
