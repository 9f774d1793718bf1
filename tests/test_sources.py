import json

import pytest
from pyspark.errors import AnalysisException

from vicinia.sources import feeds, library, links

ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
{}
</feed>
"""
ENTRY = """<entry>
  <id> https://example.org/abs/0811.54321v7 </id>
  <title>Tides
     of    the   Inner Sea</title>
  <author><name>Maren Holt</name><arxiv:affiliation>X</arxiv:affiliation></author>
  <author><name> </name></author>
  <author><name>  Pau i Vidal</name></author>
  <summary>
    Gauges were read twice a day.
  </summary>
  <published>2008-11-30T12:00:00Z</published>
  <updated>{updated}</updated>
  <category term="physics.ao-ph" scheme="s"/><category term=""/><category term="stat.AP"/>
</entry>"""


def write(folder, name, content):
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_metadata(spark, tmp_path):
    full = write(tmp_path, "full.xml", ATOM.format(ENTRY.format(updated="2008-11-30T12:00:00Z")))
    row = feeds.read_metadata(spark, full).first()
    assert row.paper_id == "0811.54321v7" and row.url.endswith("/0811.54321v7")
    assert (row.title, row.abstract) == ("Tides of the Inner Sea", "Gauges were read twice a day.")
    assert row.authors == ["Maren Holt", "Pau i Vidal"]
    assert row.date_published == row.date_updated == "2008-11-30T12:00:00Z"
    assert row.is_update is False
    assert row.categories == ["physics.ao-ph", "stat.AP"]
    newer = write(tmp_path, "newer.xml", ATOM.format(ENTRY.format(updated="2009-02-01T00:00:00Z")))
    assert feeds.read_metadata(spark, newer).first().is_update is True


def test_metadata_of_odd_files(spark, tmp_path):
    several = ATOM.format(
        "<entry><id>http://arxiv.org/abs/2401.00001</id><title>One</title></entry>"
        "<entry><id>no id here</id><title>Bad</title></entry>"
        "<entry><title>None</title></entry>"
        "<entry><id>2401.00002</id><author><name>Solo</name></author></entry>"
    )
    rows = feeds.read_metadata(spark, write(tmp_path, "several.xml", several)).orderBy("ord").collect()
    assert [(r.paper_id, r.title, r.authors) for r in rows] == [
        ("2401.00001", "One", []), ("2401.00002", "", ["Solo"]),
    ]
    empty = write(tmp_path, "empty.xml", '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"></feed>')
    bad = write(tmp_path, "bad.xml", "<<not xml>>")
    assert feeds.read_metadata(spark, [empty, bad]).isEmpty()


def test_listings(spark, tmp_path):
    one = write(
        tmp_path, "one.xml",
        '<rss><channel><item><guid isPermaLink="false">oai:arXiv.org:2401.00002v1</guid>'
        "<link>https://arxiv.org/abs/2401.77777</link></item>"
        "<item><link>https://arxiv.org/abs/2401.00001</link></item><item><link>none</link></item>"
        "</channel></rss>",
    )
    two = write(
        tmp_path, "two.xml",
        "<rss><channel><item><guid>2401.00003</guid></item><item><guid>2401.00002v1</guid></item>"
        "<item><guid>2401.00002v2</guid></item></channel></rss>",
    )
    got = feeds.read_listings(spark, {"quant-ph": one, "cs.ET": two}).orderBy("ord").collect()
    assert [r.paper_id for r in got] == ["2401.00002v1", "2401.00001", "2401.00003", "2401.00002v2"]


META = "paper_id string, title string, authors array<string>, abstract string, url string, " \
       "date_published string, date_updated string, is_update boolean, categories array<string>, ord long"


def metadata(spark, *rows):
    return spark.createDataFrame(
        [(k, t, [], "", "", None, None, False, [], i) for i, (k, t) in enumerate(rows)], META
    )


def test_enrich_keeps_request_order_and_takes_the_last_record(spark):
    meta = metadata(spark, ("2401.1v1", "old"), ("2401.2", "two"), ("2401.1v2", "new"))
    ids = spark.createDataFrame([("2401.2", 1), ("2401.9", 2), ("2401.1", 3)], "paper_id string, ord long")
    got = feeds.enrich(ids, meta).orderBy("ord").collect()
    assert [(r.paper_id, r.title) for r in got] == [("2401.2", "two"), ("2401.1v2", "new")]
    assert [r.paper_id for r in feeds.missing_metadata(ids, meta).collect()] == ["2401.9"]


def test_listed_papers_respect_versions(spark):
    meta = metadata(spark, ("2401.1v10", "ten"), ("2401.1v9", "nine"), ("2401.2v1", "b"), ("2401.2v1", "c"))
    listed = spark.createDataFrame(
        [("2401.1v9", 0), ("2401.1", 1), ("2401.2v1", 2), ("2401.2", 3), ("2401.3", 4)],
        "paper_id string, ord long",
    )
    got = feeds.listed_papers(listed, meta).orderBy("ord").collect()
    assert [(r.paper_id, r.title, r.ord) for r in got] == [
        ("2401.1v9", "nine", 0), ("2401.1v10", "ten", 1), ("2401.2v1", "c", 2),
    ]


def test_library_items(spark, tmp_path):
    items = [
        {"key": "K1", "data": {"itemType": "preprint", "title": "T", "abstractNote": "A", "DOI": "10.1/x",
                               "url": "", "date": "2024", "dateAdded": "d1", "collections": ["c1"],
                               "creators": [{"creatorType": "author", "firstName": "A", "lastName": "B"}]},
         "meta": {"dateAdded": ""}},
        {"data": {"key": "K2", "itemType": "journalArticle", "dateAdded": "d2"}},
        {"key": "K3", "data": {"itemType": "note"}},
        {"key": "K4", "data": {"itemType": "book"}},
        {"key": "", "data": {"itemType": "preprint", "key": ""}},
    ]
    path = write(tmp_path, "items.json", "\n".join(json.dumps(i) for i in items))
    rows = {r.id: r for r in library.read_items(spark, path, "zotero").collect()}
    assert set(rows) == {"zotero:K1", "zotero:K2"}
    first, second = rows["zotero:K1"], rows["zotero:K2"]
    assert (first.title, first.authors, first.url, first.doi) == ("T", ["A B"], "https://doi.org/10.1/x", "10.1/x")
    assert (first.date_added, first.date_published, first.collections) == (None, "2024", ["c1"])
    assert (second.title, second.authors, second.url, second.date_added, second.collections) == ("", [], "", "d2", [])
    # Journal articles come before preprints, whatever their place in the file.
    assert second.ord < first.ord
    books = library.read_items(spark, path, "zotero", ["book", "note"]).collect()
    assert [r.id for r in books] == ["zotero:K4"]


def test_collections(spark, tmp_path):
    lines = [
        {"key": "a", "data": {"name": "A", "parentCollection": False}},
        {"data": {"key": "b", "name": "B", "parentCollection": "a"}},
        {"data": {"name": "no key"}},
        {"key": "c", "data": {}},
    ]
    path = write(tmp_path, "collections.json", "\n".join(json.dumps(i) for i in lines))
    rows = library.read_collections(spark, path).orderBy("ord").collect()
    assert [(r.key, r.name, r.parent_key) for r in rows] == [("a", "A", None), ("b", "B", "a"), ("c", "", None)]


def test_links(spark, tmp_path):
    path = write(
        tmp_path, "links.txt",
        "# head\n\n2401.00002v2\nhttps://example.com/x\n2401.00001\r\nhttps://arxiv.org/abs/2401.00002v1\n  plain  ",
    )
    accepted, skipped = links.read_links(spark, path)
    assert [r.paper_id for r in accepted.orderBy("ord").collect()] == ["2401.00002", "2401.00001"]
    assert [(r.line_no, r.value) for r in skipped.orderBy("line_no").collect()] == [
        (4, "https://example.com/x"), (7, "plain"),
    ]


def test_line_numbers_span_file_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(1, 3001)]
    path = write(tmp_path, "long.txt", "\n".join(lines) + "\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {key: spark.conf.get(key) for key in keys}
    try:
        spark.conf.set(keys[0], "20000")
        spark.conf.set(keys[1], "1")
        rows = links.numbered_lines(spark, path)
        assert rows.select("path").rdd.getNumPartitions() >= 1
        got = {r.line_no: r.value for r in rows.collect()}
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert got == {i: line for i, line in enumerate(lines, start=1)}


def test_a_missing_links_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        links.read_links(spark, str(tmp_path / "none.txt"))
