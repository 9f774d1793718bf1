from . import feeds, landing, library, links, tables

__all__ = ["feeds", "landing", "library", "links", "tables"]
