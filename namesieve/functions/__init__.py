"""Column-level building blocks: text folding, phonetic codes, similarity, scores."""
