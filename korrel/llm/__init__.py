"""Operators that prepare text and vectors for language models. Nothing outside imports this."""
