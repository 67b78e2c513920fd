"""Subpackage functions of stratakv."""
