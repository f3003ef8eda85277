"""Composed plans: the query registry, its SQL twins and the end-to-end pipeline."""
