"""Operators over annotation, detection, image and experiment tables."""
