"""Annotation files as a stream."""
