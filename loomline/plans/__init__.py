"""Inputs that several queries share."""
