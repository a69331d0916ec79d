"""Relational operators: bags, metrics, ranking, intervals, statistics, chunks, rules."""
