"""Fixed vocabularies, lexicons and patterns used by the rule operators.

Everything in this package is plain data.  Operators take these tables as
default parameters, so another domain can pass its own.
"""
