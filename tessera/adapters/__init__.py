"""Adapters that read source text: the only part of the library that needs Python on the executors."""
