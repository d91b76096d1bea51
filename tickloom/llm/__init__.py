"""Operators for large text and matching work. Nothing outside this subpackage imports it."""
