"""Schemas of the stored tables and of the records that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.DoubleType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PAPERS = _struct(
    ("id", T.StringType()),
    ("source", T.StringType()),
    ("title", T.StringType()),
    ("authors", STRINGS),
    ("abstract", T.StringType()),
    ("url", T.StringType()),
    ("date_added", T.StringType()),
    ("date_published", T.StringType()),
)

EMBEDDINGS = _struct(
    ("paper_id", T.StringType()),
    ("model", T.StringType()),
    ("embedding", VECTOR),
    ("date_embedded", T.TimestampType()),
)

COLLECTIONS = _struct(
    ("key", T.StringType()),
    ("name", T.StringType()),
    ("parent_key", T.StringType()),
    ("ord", T.LongType()),
)

# One row per paper: replacing a paper's memberships is a keyed upsert, and an
# emptied list needs no deletion marker.
PAPER_COLLECTIONS = _struct(
    ("paper_id", T.StringType()),
    ("collection_keys", STRINGS),
)

CENTROIDS = _struct(
    ("collection_path", T.StringType()),
    ("model", T.StringType()),
    ("centroid", VECTOR),
    ("updated_at", T.TimestampType()),
    ("ord", T.LongType()),
)

#: Rows that a run could not use, with the table they were meant for or found in.
QUARANTINE = _struct(
    ("run", T.StringType()),
    ("table", T.StringType()),
    ("model", T.StringType()),
    ("id", T.StringType()),
    ("reason", T.StringType()),
)

#: Densities of a library's rows, with what tells a changed row.
LIBRARY_LOF = _struct(
    ("paper_id", T.StringType()),
    ("print", T.StringType()),
    ("kdist", T.DoubleType()),
    ("lrd", T.DoubleType()),
)

#: The lists of nearest neighbours behind the densities.
NEIGHBOR_LISTS = _struct(
    ("query_id", T.StringType()),
    ("neighbor_id", T.StringType()),
    ("distance", T.DoubleType()),
)

FEED = _struct(
    ("paper_id", T.StringType()),
    ("title", T.StringType()),
    ("authors", STRINGS),
    ("abstract", T.StringType()),
    ("url", T.StringType()),
    ("date_published", T.StringType()),
    ("date_updated", T.StringType()),
    ("is_update", T.BooleanType()),
    ("categories", STRINGS),
)

MATCHES = T.ArrayType(_struct(("title", T.StringType()), ("similarity", T.DoubleType())))

DIGEST_ITEMS = T.StructType(
    FEED.fields[:-1]
    + _struct(
        ("max_similarity", T.DoubleType()),
        ("top_matches", MATCHES),
        ("closest_collection", T.StringType()),
        ("closest_collection_score", T.DoubleType()),
        ("override_by_terms", T.BooleanType()),
        ("override_terms", STRINGS),
    ).fields
)

# ---- landed input ---------------------------------------------------------

LISTING_ENTRY = _struct(("guid", T.StringType()), ("id", T.StringType()), ("link", T.StringType()))

ATOM_ENTRY = _struct(
    ("id", T.StringType()),
    ("title", T.StringType()),
    ("author", T.ArrayType(_struct(("name", T.StringType())))),
    ("summary", T.StringType()),
    ("published", T.StringType()),
    ("updated", T.StringType()),
    ("category", T.ArrayType(_struct(("_term", T.StringType())))),
)

LIBRARY_ITEM = _struct(
    ("key", T.StringType()),
    (
        "data",
        _struct(
            ("key", T.StringType()),
            ("itemType", T.StringType()),
            ("title", T.StringType()),
            ("abstractNote", T.StringType()),
            (
                "creators",
                T.ArrayType(
                    _struct(
                        ("creatorType", T.StringType()),
                        ("firstName", T.StringType()),
                        ("lastName", T.StringType()),
                        ("name", T.StringType()),
                    )
                ),
            ),
            ("DOI", T.StringType()),
            ("url", T.StringType()),
            ("date", T.StringType()),
            ("dateAdded", T.StringType()),
            ("collections", STRINGS),
        ),
    ),
    ("meta", _struct(("dateAdded", T.StringType()))),
)

COLLECTION_ITEM = _struct(
    ("key", T.StringType()),
    (
        "data",
        _struct(
            ("key", T.StringType()),
            ("name", T.StringType()),
            ("parentCollection", T.StringType()),
        ),
    ),
)
