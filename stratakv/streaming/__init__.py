"""Subpackage streaming of stratakv."""
