"""Operators for preparing training text: each module is one operator on tables of documents or pages."""
