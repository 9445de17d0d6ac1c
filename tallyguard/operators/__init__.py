"""Operators: profiling, cleaning, rules, features, scores, evaluation, network, evidence, what-if."""
