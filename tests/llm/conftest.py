import pytest


@pytest.fixture(scope="module")
def words():
    """Invented words, by a fixed rule."""
    return [a + b + c for a in ("ka", "lo", "mi", "su", "te") for b in ("ran", "vel", "dor", "pin") for c in ("", "s", "t", "el", "on")]
