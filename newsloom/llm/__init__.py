"""Operators for preparing training data, one module each; ``queries`` applies them to whole tables."""
