"""Operators on text corpora and free-typed names. Nothing else in the library imports this subpackage."""
