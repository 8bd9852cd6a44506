"""Relational operators: lookup, references, graphs, knowledge, similarity, usage."""
