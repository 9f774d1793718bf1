"""Column expressions over identifiers, titles, terms and digest text.

Everything here is a built-in Spark expression, so it stays inside generated
code and Catalyst can push, prune and fold it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results.
PAPER_ID_PATTERN = r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)"
PAPER_URL_PREFIX = "https://arxiv.org/abs/"
DOI_URL_PREFIX = "https://doi.org/"
LINK_DOMAIN = "arxiv.org"
AUTHOR_ROLES = ("author", "editor")
# URL schemes whose last path segment may carry ";parameters" (RFC 2396 era list
# of the Python standard library).
PARAMETER_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "rtspu", "sip", "sips", "mms", "sftp", "tel",
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")


def squeeze(value: Column | str) -> Column:
    """Trim and replace each run of white space with one blank; NULL becomes ''."""
    return strip(F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"(?U)\s+", " "))


def not_empty(value: Column | str) -> Column:
    """The value, or NULL where it is ''."""
    return F.nullif(_col(value), F.lit(""))


# ---- identifiers and links ------------------------------------------------


def paper_id(value: Column | str) -> Column:
    """First paper ID found in a URL or free text, with its version; NULL if none."""
    return not_empty(F.regexp_extract(_col(value), PAPER_ID_PATTERN, 1))


def canonical_id(value: Column | str) -> Column:
    """The ID without its trailing version."""
    return F.regexp_replace(_col(value), r"v\d+$", "")


def version_number(value: Column | str) -> Column:
    """The version at the end of an ID, 0 if there is none."""
    return F.coalesce(not_empty(F.regexp_extract(_col(value), r"v(\d+)$", 1)).cast("int"), F.lit(0))


def link_paper_id(value: Column | str, domain: str = LINK_DOMAIN) -> Column:
    """Canonical ID of a link line, NULL where the line is not a supported link.

    A line with a scheme or an authority must point at ``domain``; any other
    line is searched for an ID as it is.
    """
    line = strip(value)
    url = F.regexp_replace(line, "[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.when(scheme != "", F.regexp_replace(url, r"^[^:]*:", "")).otherwise(url)
    authority = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    path = F.when(
        scheme.isin(*PARAMETER_SCHEMES), F.regexp_replace(path, r";[^/]*$", "")
    ).otherwise(path)
    host = F.regexp_replace(F.lower(F.coalesce(not_empty(authority), path)), r"^www\.", "")
    is_url = (scheme != "") | (authority != "")
    return F.when(~is_url | host.endswith(domain), canonical_id(paper_id(line)))


def paper_url(value: Column | str, prefix: str = PAPER_URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), _col(value))


def url_or_doi(url: Column | str, doi: Column | str) -> Column:
    """The URL, or the DOI's address where the URL is empty."""
    url, doi = F.coalesce(_col(url), F.lit("")), F.coalesce(_col(doi), F.lit(""))
    return F.when((url == "") & (doi != ""), F.concat(F.lit(DOI_URL_PREFIX), doi)).otherwise(url)


def source_key(source: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{source}:"), _col(key))


def is_update(published: Column | str, updated: Column | str) -> Column:
    """Both stamps are given and differ as text."""
    published, updated = _col(published), _col(updated)
    return F.coalesce((published != "") & (updated != "") & (published != updated), F.lit(False))


# ---- names and lists ------------------------------------------------------


def category_terms(categories: Column | str) -> Column:
    terms = F.transform(_col(categories), lambda c: c["_term"])
    return F.coalesce(F.filter(terms, lambda t: t != ""), F.array().cast("array<string>"))


def author_names(authors: Column | str) -> Column:
    names = F.filter(F.transform(_col(authors), lambda a: a["name"]), lambda n: n != "")
    return F.coalesce(F.transform(names, strip), F.array().cast("array<string>"))


def creator_names(creators: Column | str) -> Column:
    """Names of authors and editors in order: ``first last``, else the single name."""

    def name(creator: Column) -> Column:
        first = F.coalesce(creator["firstName"], F.lit(""))
        last = F.coalesce(creator["lastName"], F.lit(""))
        return F.when(
            (first != "") | (last != ""), strip(F.concat(first, F.lit(" "), last))
        ).otherwise(not_empty(creator["name"]))

    kept = F.filter(_col(creators), lambda c: c["creatorType"].isin(*AUTHOR_ROLES))
    names = F.filter(F.transform(kept, name), lambda n: n.isNotNull())
    return F.coalesce(names, F.array().cast("array<string>"))


def decode_authors(authors_json: Column | str) -> Column:
    """Author list from its JSON text; NULL or '' gives an empty list."""
    return F.coalesce(
        F.from_json(_col(authors_json), "array<string>"), F.array().cast("array<string>")
    )


# ---- text to embed --------------------------------------------------------


def embedding_text(title: Column | str, authors: Column | str, abstract: Column | str) -> Column:
    """Labelled title, authors and abstract on lines of their own; empty parts left out."""
    title, authors, abstract = _col(title), _col(authors), _col(abstract)
    return F.concat_ws(
        "\n",
        F.when(title != "", F.concat(F.lit("Title: "), title)),
        F.when(F.size(authors) > 0, F.concat(F.lit("Authors: "), F.array_join(authors, ", "))),
        F.when(abstract != "", F.concat(F.lit("Abstract: "), abstract)),
    )


def has_text(text: Column | str) -> Column:
    return strip(text) != ""


def first_line(text: Column | str) -> Column:
    return F.substring_index(_col(text), "\n", 1)


def after_first_line(text: Column | str) -> Column:
    text = _col(text)
    return F.when(
        F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))
    ).otherwise("")


def title_or_id(title: Column | str, key: Column | str) -> Column:
    return F.coalesce(not_empty(strip(title)), _col(key))


# ---- terms ----------------------------------------------------------------


def folded(value: object) -> Column:
    """A setting as the text that is looked for: null if it is blank. Catalyst folds it into a constant."""
    return not_empty(F.lower(strip(F.lit(str(value)))))


def haystack(title: Column | str, abstract: Column | str) -> Column:
    """The lower-cased text that terms are looked for in."""
    none = F.lit("")
    return F.lower(F.concat(F.coalesce(_col(title), none), F.lit("\n"), F.coalesce(_col(abstract), none)))


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def matched_terms(title: Column | str, abstract: Column | str, terms: Sequence[object]) -> Column:
    """Terms, folded, that occur anywhere in title or abstract, in their order; blank ones never do."""
    if not terms:
        return string_array([])
    searched = haystack(title, abstract)
    hits = [F.when(F.contains(searched, folded(term)), folded(term)) for term in terms]
    # Joined and split again, not filtered as an array: array lambdas leave
    # generated code, and the haystack would be built once per term.
    mark = next(c for c in map(chr, range(1, 9)) if not any(c in str(term) for term in terms))
    joined = F.concat_ws(mark, *hits)
    return F.when(joined == "", string_array([])).otherwise(F.split(joined, mark))


# ---- digest text ----------------------------------------------------------


def snippet(text: Column | str, length: int = 300, mark: str = "…") -> Column:
    """The first ``length`` characters, marked where something was left off."""
    text = _col(text)
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))
    ).otherwise(text)


def card_snippet(text: Column | str) -> Column:
    return snippet(text, 400, "...")


def plural(count: Column | str) -> Column:
    return F.when(_col(count) == 1, "").otherwise("s")


def section(is_update_flag: Column | str) -> Column:
    return F.when(F.coalesce(_col(is_update_flag), F.lit(False)), "update").otherwise("new")


def excluded_name(name: Column | str, excluded: Sequence[str]) -> Column:
    """The collection name, trimmed and lower-cased, is one of ``excluded``."""
    own = strip(F.lower(F.coalesce(_col(name), F.lit(""))))
    return F.coalesce(own.isin(*[folded(other) for other in excluded]), F.lit(False))
