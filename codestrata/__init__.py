"""Corpora of labelled source code on Spark: clean, tokenise, vectorise, split, pair, search, cluster, vote, score."""
