"""Scalar functions: expressions on columns, JVM-side but for ``slugify``."""
