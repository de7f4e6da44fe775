"""Distributed analytics over multi-source document collections."""
