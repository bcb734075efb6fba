"""Training-data operators: filters, scoring, near-duplicate joins, mixing and tokenisation.

Nothing outside this folder imports it; removing the folder leaves the rest of the library whole.
"""
