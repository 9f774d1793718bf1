from . import stream

__all__ = ["stream"]
