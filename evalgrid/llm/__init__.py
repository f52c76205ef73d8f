"""Operators for preparing training corpora; one module per operator.

Nothing outside this package imports it, and it imports nothing from the rest
of the library.
"""
