"""Part of the slide-annotation analytics library."""
