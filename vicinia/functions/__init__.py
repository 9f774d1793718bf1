from . import text, vectors

__all__ = ["text", "vectors"]
