"""Operators that a large-scale training-data pipeline needs; nothing else in quarry imports them."""
