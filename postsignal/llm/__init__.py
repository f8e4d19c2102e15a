"""Operators for preparing training text: finding, scoring, removing, encoding, packing."""
