"""Shared building blocks for the operators."""
