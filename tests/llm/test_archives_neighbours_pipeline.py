"""Web archives, approximate neighbours and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vicinia.llm import near, neighbours, warc
from vicinia.session import cut

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# ---- archives ----------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, archive string, key int"
    )


def brute_records(rows, least=1000):
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = best.get(data)
        revisit = keeper is not None and keeper != i
        out.append(
            (i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None)
        )
    return sorted(out, key=str)


def test_archives_give_back_all_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    dice = random.Random(1)
    big = ["é<p>" + "x" * 1000, "y" * 1000, "z" * 999]
    rows = [
        (k, f"http://{'Hot' if k % 3 else f'h{k}'}.example.org:80/a b/{k % 20}?q=é#f", dice.choice([*big, None, "", f"p{k}\r\n\r\nq"]))
        for k in range(150)
    ]
    rows += [(1000, None, big[0]), (1001, "", "w"), (1002, "no scheme\n", None), (-5, "ftp://u:p@x.y/", big[1])]
    rows.append((1003, "http://long.example.org", "l" * 300_000))
    got = warc.round_trip(pages_of(spark, rows)).collect()
    found = sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str
    )
    assert found == brute_records(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response")
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")


def test_archives_of_repeated_and_null_ids(spark):
    rows = [(None, "http://a.b/", "n" * 1200), (4, "http://a.b/", "n" * 1200), (4, "http://a.b/", "n" * 1200), (None, None, None)]
    got = warc.round_trip(pages_of(spark, rows), keep_payload=False).collect()
    found = sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str
    )
    assert found == brute_records(rows)
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_records_are_gzip_members_found_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(k, f"https://www.s{k % 4}.example.com/p/{k}", f"page {k}") for k in range(40)]
    captures = warc.write_archives(pages_of(spark, rows), str(tmp_path / "archives"))
    ranges = warc.write_index(captures, str(tmp_path / "index"))
    entry = captures.where("page_id = 7").first()
    with open(tmp_path / "archives" / entry["archive"], "rb") as source:
        source.seek(entry["offset"])
        text = gzip.decompress(source.read(entry["length"])).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("page 7\r\n\r\n")
    wanted = pages_of(spark, [rows[9], rows[9], (99, "https://absent.example.com/", None)])
    got = warc.look_up(wanted, str(tmp_path / "archives"), str(tmp_path / "index"), ranges).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in got] == [(9, b"page 9")]
    index = warc.IndexFile(*[(s, f"{p}/{ranges.first()['file']}") for s, p in [warc.filesystem(str(tmp_path / "index"))]][0])
    assert index.firsts == sorted(index.firsts) and index.find("nothing") == []


def test_search_keys_reverse_the_host():
    assert warc.search_key("http://User:x@WWW.Example.ORG:81/A?b#c", 5) == "org,example,www)/A?b 5"
    assert warc.page_of(warc.record_id(-3)) == -3 and warc.page_of(warc.record_id(None)) is None
    record = warc.build_record(1, "http://a/", b"data", None, False)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"data", b"dxta"))


# ---- neighbours --------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")


def brute_neighbours(ids, x, asked, k):
    out = {}
    for q in asked:
        i = ids.index(q)
        scores = [(-float((x[j] * x[i]).sum()), ids[j]) for j in range(len(ids)) if ids[j] != q]
        out[q] = sorted(scores)[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1400, 16)), np.repeat(rng.normal(size=(1, 16)), 600, axis=0)]).astype(np.float32)
    x *= rng.uniform(0.5, 2, size=(len(x), 1)).round(1).astype(np.float32)
    x[1400:] = x[1400]
    ids = list(range(len(x)))
    df = vectors_of(spark, [(i, v.tolist()) for i, v in zip(ids, x, strict=True)])
    got = {}
    for r in neighbours.search(df, F.pmod(F.col("id"), F.lit(50)) == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(np.float64)
    want = brute_neighbours(ids, x, ids[::50], 10)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(s == pytest.approx(float(x[q] @ x[v]), abs=1e-12) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for _, v in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 1.0]), (1, [1.0, 0.0, 1.0]), (2, [0.0, 2.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]),
        (6, [inf, 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [1.0, 1.0]), (9, [-1.0, 0.0, 0.0]), (20, [2.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
        (40, []), (60, None), (20, [2.0, 0.0, 0.0]),
    ]
    asks = F.pmod(F.col("id"), F.lit(20)) == 0
    got = sorted(map(tuple, neighbours.search(vectors_of(spark, rows), asks).collect()))
    assert got == [
        (0, 1, 1, 2.0), (0, 2, 20, 2.0), (0, 3, 20, 2.0), (0, 4, 2, 0.0), (0, 5, 9, -1.0),
        (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 0.0), (20, 4, 9, -2.0),
    ]
    assert neighbours.search(vectors_of(spark, []), asks).count() == 0
    assert neighbours.search(vectors_of(spark, [(0, [1.0])]), asks).count() == 0


def test_cells_are_packed_into_blocks_of_bounded_size():
    first, parts, blocks = neighbours.pack(np.array([5, 3, 25, 0, 9, 1]), rows=10)
    assert blocks == 5
    assert first.tolist() == [0, 0, 1, 4, 4, 4] and parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(0)
    quantiser = neighbours.Quantiser(rng.normal(size=(7, 2)), rng.normal(size=(5, 3)), 1.0)
    counts = rng.integers(0, 3, 35)
    query = rng.normal(size=5)
    cells = neighbours.traverse(query, quantiser, counts, np.inf)
    sums = -(quantiser.left @ query[:2])[:, None] - (quantiser.right @ query[2:])[None, :]
    want = [int(c) for c in np.argsort(sums.ravel(), kind="stable") if counts[c]]
    assert cells == want
    few = neighbours.traverse(query, quantiser, counts, 5)
    assert few == want[: len(few)] and counts[few].sum() >= 5 > counts[few[:-1]].sum()


# ---- pipeline ----------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark):
    """The given documents, with more that each stage should act on, and what every stage leaves."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"the of and word{k}" for k in range(120))
    planted = [
        (9001, "12 34 -- !!", "en", "src0", 11), (9002, None, None, None, None), (9003, long, "en", "src1", len(long)),
        (9004, long + " tail", "en", None, 1), (9005, "the mail of ann.b@example.org and the rest", "en", "src2", None),
        (9005, "the mail of ann.b@example.org and the rest", "en", "src2", None), (None, "the id is absent of the row", "en", "src3", 3),
    ]
    docs = given.unionByName(spark.createDataFrame(planted, DOCS)).withColumn("score", F.lit(1)).withColumn("kept", F.lit("k"))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], "/root/testdata/sf0.001")))
    return seen


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "personal_data", "mixing", "byte_bpe"]
    assert all(s.schema == stages[0].schema or s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_language_stage_rejects_what_has_no_language(stages):
    before, after = (sorted((r["doc_id"] for r in s.collect()), key=str) for s in stages[:2])
    assert [i for i in before if i not in after] == [9001, 9002]


def test_near_stage_keeps_one_of_each_class(spark, stages):
    classes = near.near_duplicates(stages[1], threshold=80).collect()
    want = {r["component_id"] for r in classes}
    got = [r["doc_id"] for r in stages[2].collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 9003 in got and 9004 not in got and None in got


def test_personal_data_stage_redacts(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    assert after[9005]["text"] == "the mail of <EMAIL> and the rest" and after[9005]["n_chars"] is None
    for i, row in after.items():
        assert row["text"] == before[i]["text"] or row["n_chars"] in (None, len(row["text"]))
        assert "@" not in row["text"]


def test_mixing_stage_nears_its_targets(spark, stages):
    from vicinia.llm import mixing

    mixed = mixing.mix(stages[3], carry=["source"]).collect()
    goal, longest = {}, {}
    for r in mixed:
        goal[r["source"]] = r["target"]
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
    got = {}
    for r in stages[4].collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(got.get(s, 0) - t) <= longest[s] / 2 + 1 for s, t in goal.items())


def test_last_stage_encodes_every_document(stages):
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stages[4].collect())
    rows = stages[5].collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == texts
    assert all(r["round_trip"] and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)


def test_stages_pass_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, "/root/testdata/sf0.001"))
    assert docs.count() == 0
