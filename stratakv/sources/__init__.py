"""Subpackage sources of stratakv."""
