"""Column functions. Everything here stays inside the JVM unless its docstring says otherwise."""

from citegrove.functions.text import doi_name, field_values, plain, ref_name, split_auto, split_semicolon

__all__ = ["doi_name", "field_values", "plain", "ref_name", "split_auto", "split_semicolon"]
