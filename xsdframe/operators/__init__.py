"""Operators over XML columns: shredding, typing, checking and writing."""
