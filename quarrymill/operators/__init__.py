"""Operators on record tables, pages, reports and workspace tables."""
