"""Readers and writers of slides, annotation files, tiles and reports."""
