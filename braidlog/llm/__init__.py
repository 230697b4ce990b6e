"""Operators on the texts of conversations and documents."""
