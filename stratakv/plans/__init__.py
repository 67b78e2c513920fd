"""Subpackage plans of stratakv."""
