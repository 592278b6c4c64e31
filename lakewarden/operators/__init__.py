"""Data operators: contract, bronze, dedupe, table states, discovery, reconciliation."""
