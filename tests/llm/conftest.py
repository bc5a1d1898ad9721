"""Fixtures come from the tests folder above."""
