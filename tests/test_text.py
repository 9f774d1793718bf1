import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.functions import text
from vicinia.operators import terms
from vicinia.operators.relevance import Settings


def one(spark, **columns):
    """Evaluate column expressions on a single row."""
    row = spark.range(1).select(*[value.alias(name) for name, value in columns.items()]).first()
    return row.asDict()


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("see https://example.org/pdf/1911.04321v12.pdf", "1911.04321v12"),
        ("0704.0001", "0704.0001"),
        ("tag:0704.0002v4", "0704.0002v4"),
        (" 1203.98765 trailing 1203.11111", "1203.98765"),
        ("hep-th/9711200", "hep-th/9711200"),
        ("q-bio.NC/0512003v2", "q-bio.NC/0512003v2"),
        ("x.ab-cd.efg/0512003", "efg/0512003"),
        ("99999.123456", "9999.12345"),
        ("123.4567", None),
        ("HEP-TH/9711200", None),
        (" ", None),
    ],
)
def test_paper_id(spark, raw, wanted):
    assert one(spark, x=text.paper_id(F.lit(raw)))["x"] == wanted


LINKS = [
    ("2401.00001v2", "2401.00001"),
    ("  2401.00001  ", "2401.00001"),
    ("https://www.arxiv.org/abs/2401.00003v1", "2401.00003"),
    ("HTTPS://ARXIV.ORG/abs/2401.00003", "2401.00003"),
    ("https://example.com/2401.00002", None),
    ("http://notarxiv.org/abs/2401.00005", "2401.00005"),
    ("http://arxiv.org:80/abs/2401.00004", None),
    ("oai:arXiv.org:2401.12345", None),
    ("http:arxiv.org?2401.12345", "2401.12345"),
    ("//arxiv.org/abs/2401.00006", "2401.00006"),
    ("//example.org/abs/2401.00006", None),
    ("arxiv.org/abs/2401.00007", "2401.00007"),
    ("http://arxiv.org/abs/none", None),
    ("http:///abs/2401.00008", None),
    ("plain", None),
    ("", None),
]


def test_link_paper_id(spark):
    rows = spark.createDataFrame(LINKS, "value string, wanted string")
    got = rows.select("value", "wanted", text.link_paper_id("value").alias("got")).collect()
    assert [(r.value, r.got) for r in got] == [(r.value, r.wanted) for r in got]


def test_squeeze_and_strip_take_all_white_space(spark):
    raw = "  a\n\tb  c  "
    got = one(spark, s=text.squeeze(F.lit(raw)), t=text.strip(F.lit(raw)), n=text.squeeze(F.lit(None)))
    assert got == {"s": "a b c", "t": raw.strip(), "n": ""}


def test_is_update_compares_text(spark):
    cases = [("a", "a", False), ("a", "b", True), ("", "b", False), (None, "b", False)]
    rows = spark.createDataFrame(cases, "p string, u string, wanted boolean")
    assert all(r.got == r.wanted for r in rows.withColumn("got", text.is_update("p", "u")).collect())


def test_embedding_text(spark):
    full = text.embedding_text(
        F.lit("On Moss"), text.string_array(["Ines Prado", "K. Ek", "Ulf"]), F.lit("Moss grows\nslowly.")
    )
    none = text.string_array([])
    got = one(
        spark,
        full=full,
        no_authors=text.embedding_text(F.lit("Fern"), none, F.lit("Spores.")),
        empty=text.embedding_text(F.lit(""), none, F.lit("")),
        no_abstract=text.embedding_text(F.lit("Bark"), text.string_array(["Oda"]), F.lit("")),
        nulls=text.embedding_text(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit("x")),
        blank_title=text.has_text(text.embedding_text(F.lit("  "), none, F.lit(""))),
    )
    assert got["full"] == "Title: On Moss\nAuthors: Ines Prado, K. Ek, Ulf\nAbstract: Moss grows\nslowly."
    assert got["no_authors"] == "Title: Fern\nAbstract: Spores."
    assert got["empty"] == ""
    assert got["no_abstract"] == "Title: Bark\nAuthors: Oda"
    assert got["nulls"] == "Abstract: x"
    assert got["blank_title"] is True


def test_settings_are_folded(spark):
    given = Settings(always_include_terms=("\tLICHEN moss\n", 7.5, " ", None, "ÄHRE"), excluded_collections="lichen")
    got = one(spark, **{f"t{k}": text.folded(term) for k, term in enumerate(given.terms)})
    assert list(got.values()) == ["lichen moss", "7.5", None, "none", "ähre"]
    assert given.excluded_names == () and Settings(always_include_terms="lichen").terms == ()
    got = one(spark, hit=text.excluded_name(F.lit(" Moss "), [" ", "MOSS"]), blank=text.excluded_name(F.lit(None), [" "]))
    assert got == {"hit": True, "blank": False}


def test_matched_terms_keep_order_and_match_inside_words(spark):
    title, abstract = F.lit("Ferns under GLASS"), F.lit("overgrown houses\nof glasswork")
    got = one(
        spark,
        hits=text.matched_terms(title, abstract, ["work", "grown h", "glass\nover", "ice", "fern"]),
        none=text.matched_terms(title, abstract, []),
        null=text.matched_terms(F.lit(None), F.lit(None), ["fern"]),
    )
    assert got == {"hits": ["work", "grown h", "glass\nover", "fern"], "none": [], "null": []}


@pytest.mark.parametrize("few", [0, 50])
def test_terms_as_a_table_match_like_the_expression(spark, few, monkeypatch):
    monkeypatch.setattr(terms, "BROADCAST_CHARACTERS", 12)
    listed = [" Root", "oo", "x" * 9, "", "tree\n", "root", "é", "öö", None]
    rows = spark.createDataFrame(
        [(1, "Tree roots", "éclair"), (2, None, "TREE"), (3, None, None), (4, "nothing", "here")],
        "id int, title string, abstract string",
    )
    table = spark.createDataFrame(list(enumerate(listed)), "ord bigint, term string")
    got = {r.id: r.matched_terms for r in terms.match(rows, table, few=few).collect()}
    assert got == {1: ["root", "oo", "tree", "é"], 2: ["tree"], 3: [], 4: []}
    monkeypatch.setattr(terms, "BROADCAST_CHARACTERS", 0)
    again = terms.match(rows.withColumn("matched_terms", F.lit("old")), table, few=few).collect()
    assert {r.id: r.matched_terms for r in again} == got


def test_many_random_terms(spark):
    dice = random.Random(3)
    listed = sorted({"".join(dice.choices("abé ", k=dice.randint(1, 6))) for _ in range(120)})
    titles = ["".join(dice.choices("abé \n", k=dice.randint(0, 40))) for _ in range(40)]
    rows = spark.createDataFrame(
        [(k, t if k % 7 else None, titles[k // 2]) for k, t in enumerate(titles)], "id int, title string, abstract string"
    )
    table = spark.createDataFrame(list(enumerate(listed)), "ord bigint, term string")
    got = {r.id: r.matched_terms for r in terms.match(rows, table).collect()}
    folded = list(dict.fromkeys(t for term in listed if (t := term.strip())))
    for r in rows.collect():
        seen = f"{r.title or ''}\n{r.abstract or ''}"
        assert got[r.id] == [t for t in folded if t in seen]


def test_creator_names(spark):
    creator = T.ArrayType(
        T.StructType([T.StructField(n, T.StringType()) for n in ("creatorType", "firstName", "lastName", "name")])
    )
    data = [(
        [
            ("author", "Ada", "Lovelace", None), ("translator", "No", "One", None),
            ("editor", None, None, "Consortium"), ("author", "", "Solo", None),
            ("author", "", "", ""),
        ],
    )]
    rows = spark.createDataFrame(data, T.StructType([T.StructField("c", creator)]))
    assert rows.select(text.creator_names("c")).first()[0] == ["Ada Lovelace", "Consortium", "Solo"]


def test_small_helpers(spark):
    got = one(
        spark,
        doi=text.url_or_doi(F.lit(""), F.lit("10.1/x")),
        url=text.url_or_doi(F.lit("u"), F.lit("10.1/x")),
        none=text.url_or_doi(F.lit(None).cast("string"), F.lit(None).cast("string")),
        canonical=text.canonical_id(F.lit("2401.1v12")),
        version=text.version_number(F.lit("2401.1v12")),
        authors=text.decode_authors(F.lit('["A", "B"]')),
        no_authors=text.decode_authors(F.lit(None).cast("string")),
        title=text.title_or_id(F.lit("  "), F.lit("id")),
        exact=text.snippet(F.lit("x" * 300)),
        longer=text.snippet(F.lit("x" * 301)),
        card=text.card_snippet(F.lit("y" * 401)),
    )
    assert got["doi"] == "https://doi.org/10.1/x" and got["url"] == "u" and got["none"] == ""
    assert got["canonical"] == "2401.1" and got["version"] == 12
    assert got["authors"] == ["A", "B"] and got["no_authors"] == []
    assert got["title"] == "id"
    assert got["exact"] == "x" * 300 and got["longer"] == "x" * 300 + "…"
    assert got["card"] == "y" * 400 + "..."


def test_a_table_of_terms_is_searched_in_words_once(spark, monkeypatch):
    """Spaces of any kind, parts inside words, short parts, and runs made for each distinct word only."""
    texts = ["Alpha  beta gammas\tdelta", "xalphax be\nta ab cd", "alpha beta gamma", "a b c", "", None] + ["same words again"] * 3
    rows = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "id int, title string, abstract string")
    listed = ["ALPHA", "beta gamma", "gammas\tdelta", "ab cd", "a b", "b", "lph", "words", "e w", "beta  gamma", "gone"]
    table = spark.createDataFrame(list(enumerate(listed)), "ord long, term string")
    got = {r.id: r.matched_terms for r in terms.match(rows, table, few=0).collect()}
    assert got == {r.id: r.matched_terms for r in terms.match(rows, table, few=99).collect()}
    assert got[0] == ["alpha", "beta gamma", "gammas\tdelta", "b", "lph"] and got[1] == ["alpha", "ab cd", "b", "lph"]
    written, cut = [], terms.cut
    monkeypatch.setattr(terms, "cut", lambda df: written.append(cut(df)) or written[-1])
    terms.match(rows, table, few=0)
    # No anchor is looked for in whole texts: the words of all texts are stored once.
    assert any(t.columns == ["word"] and t.count() == len({w for x in texts if x for w in x.lower().split()} | {""}) for t in written)


def test_a_worker_keeps_few_tokens():
    from vicinia.operators import embed

    model = embed.TokenHashEmbedder("4")
    model.embed_batch([" ".join(map(str, range(150_000)))])
    model.embed_batch(["a"])
    assert len(model._places) == 1
