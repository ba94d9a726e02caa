"""Column-level building blocks: keys, genotype calls, annotation terms, clinical text, p-values."""
