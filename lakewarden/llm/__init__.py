"""Operators for preparing training data: dedup, decontamination, classifiers, tokens, fixity."""
