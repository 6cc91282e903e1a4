"""Expressions for XSD's lexical and value rules; all stay in the JVM."""

from .sql import F, let, once

__all__ = ["F", "let", "once"]
