"""Operators for preparing training text: filters, deduplication, packing, formats. Nothing else in the library imports them."""
