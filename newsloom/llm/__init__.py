"""Operators for preparing training text.  Nothing else in newsloom imports this subpackage."""
