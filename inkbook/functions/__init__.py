"""Column-expression helpers: figure formatting and text-audit functions."""
