"""Subpackage of gramlake."""
