"""Analytic marts. Each takes the derived jobs frame plus ``by`` keys."""
