"""Columns of our own beside those of the user."""

import uuid


def fresh_name(stem: str) -> str:
    """A column name that no table of the user has."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"
