"""Compiling schema files on the driver: declarations, types, and Spark schemas."""
