"""Subpackage operators of stratakv."""
