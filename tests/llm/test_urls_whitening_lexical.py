"""URL rules, whitening and ranked search against plain computations."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from vicinia.llm import lexical, urls, whitening

# ---- URL rules -------------------------------------------------------------------


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(h + p), len(h), v, h + p)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("example.com", "/de/se", "allow"), ("example.com", "/de/secret/x", "block"), ("a.b.example.com", "", "block"),
    ("com", "/", "allow"), ("com", "/", "block"), ("é.org", "/ü/", "block"), ("deep.org", "/1/2/3/4/5/6", "block"),
    ("b.org", "/a", "block"), ("", "/only/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http:///only/x", "http://Example.NET/en/1", "https://www.example.net/EN/1",
    "x://example.com/de/se", "x://example.com/de/s", "x://m.example.com/de/secret/x/y?de#f", "x://a.b.example.com",
    "x://a.b.example.com?q", "x://notexample.com/de/1", "x://é.org/ü/1", "x://É.org/ü/1", "x://net", "x://net/",
    "x://x.net:80/", "x://u@x.net/#://y", "x://deep.org/1/2/3/4/5/66", "x://deep.org/1/2/3/4/5/7", "x://b.org/abc/",
    "x://org/fr/", "x://org./fr/", "x://..org//fr/", "x://b.org//a", "\nx://b.org/a\nb", "x://y.com/" + "a/" * 30_000,
]


def pages_of(spark, rows):
    return spark.createDataFrame(
        [(i, u, "r", "v", k) for k, (i, u) in enumerate(rows)],
        "page_id bigint, url string, rule string, verdict string, part int",
    )


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


@pytest.mark.parametrize("budget", [urls.BROADCAST_BYTES, 0])
def test_url_rules_equal_all_pairs(spark, budget):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[5]), (3, URLS[5]), (3, URLS[5])]
    rows += [(100 + k, "https://www.example.net/en/hot") for k in range(200)]
    got = urls.judge(pages_of(spark, rows), rules_of(spark, RULES), broadcast_bytes=budget).collect()
    want = Counter((i, *plain_verdict(u, RULES)) for i, u in rows)
    assert Counter(map(tuple, got)) == want


def test_url_rules_defaults_and_empty_tables(spark):
    pages = pages_of(spark, [(1, "x://a.net/"), (None, None)])
    none = rules_of(spark, []).limit(0)
    assert Counter(map(tuple, urls.judge(pages, none, default="block").collect())) == Counter(
        {(1, "a.net", "/", None, "block"): 1, (None, "", "", None, "block"): 1}
    )
    odd = rules_of(spark, [(None, "/", "block"), ("net", None, "block"), ("a.net", "/", "maybe"), ("a.net", "/", None)])
    got = urls.judge(pages, odd, keep=("url", "part")).where("page_id = 1").first()
    assert tuple(got) == (1, "x://a.net/", 0, "a.net", "/", "net", "block")
    assert urls.judge(pages.limit(0), odd).collect() == []


def test_url_rules_hot_stem_and_random(spark):
    dice = random.Random(4)
    labels, folders = ["a", "b", "c"], ["x", "y", ""]
    rules = {
        (".".join(dice.choices(labels, k=dice.randint(1, 3))), "/" + "/".join(dice.choices(folders, k=dice.randint(0, 3))))
        for _ in range(60)
    }
    rules = [(h, p, dice.choice(["allow", "block"])) for h, p in sorted(rules)]
    rules += [("hot", f"/{k}", "block") for k in range(300)]
    rows = [
        (k, f"u://{'.'.join(dice.choices(labels, k=dice.randint(1, 4)))}/{'/'.join(dice.choices(folders, k=dice.randint(0, 4)))}")
        for k in range(300)
    ]
    rows += [(1000 + k, f"u://hot/{k}") for k in range(400)]
    got = urls.judge(pages_of(spark, rows), rules_of(spark, rules)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain_verdict(u, rules)) for i, u in rows)


def test_url_rules_use_no_python_workers(spark):
    found = urls.judge(pages_of(spark, [(1, URLS[5])]), rules_of(spark, RULES))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


# ---- whitening -------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1.0, 2) for i, v in rows], "vec_id bigint, embedding array<double>, whitened double, n int"
    )


def check_whitening(spark, good, extra=(), components=32):
    rows = [(k, v) for k, v in enumerate(good)]
    found = whitening.whiten(vectors_of(spark, [*rows, *extra]), components=components).toPandas()
    x = np.floor(np.array(good, float) * 64).astype(np.int64) + 1_000_000
    n, dim = x.shape
    width = min(components, dim)
    assert len(found) == n * width and set(found["n"]) == {n}
    sums = [int(s) for s in x.astype(object).sum(axis=0)]
    for k in range(n):
        want = sum((n * int(a) - s) ** 2 for a, s in zip(x[k], sums, strict=True))
        assert set(found.loc[found.vec_id == k, "deviation"].map(int)) == {want}
    centred = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    for c in range(width):
        column = found[found.component == c + 1].sort_values("vec_id")
        assert column["explained"].iloc[0] == pytest.approx(values[c] / values.sum(), rel=1e-9, abs=1e-12)
        if values[c] > 1e-9 * values[0]:
            w = column["whitened"].to_numpy()
            assert (w * w).mean() == pytest.approx(1, abs=1e-9)
            # A direction of the covariance: V (X^T w) = e X^T w.
            axis = centred.T @ w
            assert np.allclose(centred.T @ (centred @ axis) / n, values[c] * axis, rtol=0, atol=1e-7 * np.abs(values[0] * axis).max())
    assert found["identity_error"].iloc[0] < 1e-9
    assert found["identity_error"].nunique() == 1
    return found


def test_whitening_of_random_vectors_with_unusable_ones(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 6)) * [1, 2, 3, 3, 5, 9] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    extra = [
        (900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [float("nan")] * 6),
        (905, [float("inf")] + [0.0] * 5),
    ]
    check_whitening(spark, good.tolist(), extra)
    check_whitening(spark, good.tolist(), extra, components=2)


def test_whitening_without_variance(spark):
    same = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in same)
    flat = [[float(k), 1.0, 2.0 * k] for k in range(20)]
    found = check_whitening(spark, flat)
    assert found[found.component > 1]["whitened"].isna().all()
    assert whitening.whiten(vectors_of(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors_of(spark, []).limit(0)).collect() == []


def test_whitening_keeps_huge_sums_exact(spark):
    good = [[1e6 * k, 3e9, -5e12 * (k % 3)] for k in range(40)]
    check_whitening(spark, good)
    far = whitening.whiten(vectors_of(spark, [(1, [1e300, 1.0]), (2, [-1e300, 0.0])])).collect()
    assert len(far) == 4


def test_refinement_handles_clusters():
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in (
        np.arange(1, 41.0),
        np.repeat([1.0, 2.0, 3.0, 4.0], 10),
        np.concatenate([1 + 1e-9 * np.arange(20), 2 + 1e-12 * np.arange(20)]),
        np.concatenate([np.geomspace(1e-10, 1, 39), [1 + 1e-8]]),
        np.zeros(40),
    ):
        a = turn @ np.diag(values) @ turn.T
        a = (a + a.T) / 2
        found, x = whitening.eigenvectors(a)
        assert np.all(np.diff(found) <= 1e-15)
        assert np.allclose(found, values[::-1], rtol=0, atol=4e-15 * max(values.max(), 1))
        assert np.abs(x.T @ x - np.eye(40)).max() < 1e-14
        assert np.abs(a @ x - x * found).max() < 4e-15 * max(values.max(), 1) * 2
    _, start = np.linalg.eigh((turn @ np.diag(np.arange(1, 41.0)) @ turn.T).astype(np.float32))
    rough = np.abs(start.astype(float).T @ start.astype(float) - np.eye(40)).max()
    assert rough > 1e-8


# ---- ranked search ---------------------------------------------------------------


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_scores(docs, items):
    bags = [Counter(plain_terms(t)) for _, t in docs]
    n, total = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (doc, _), bag in zip(docs, bags, strict=True):
            if not bag:
                continue
            m = 50 + 50 * sum(bag.values()) * n // total
            score = sum(
                lexical.weight(n, df[t]) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(plain_terms(text)) if t in bag
            )
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(found[:50])]
    return out


def make_corpus(dice, count):
    words = [f"w{k}" for k in range(40)] + ["Ünder", "straße", "x_y", "A1"]
    heavy = [1 / (1 + k) for k in range(len(words))]
    docs = [(k, " ".join(dice.choices(words, heavy, k=dice.randint(0, 30)))) for k in range(count)]
    items = [(k, ", ".join(dice.choices(words, k=dice.randint(1, 12)))) for k in range(15)]
    return docs, items


def tables_of(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2.0, 3) for i, t in docs], "doc_id bigint, text string, rank int, score double, q int"),
        spark.createDataFrame([(i, t, 9) for i, t in items], "item_id bigint, text string, doc_id int"),
    )


@pytest.mark.parametrize("limit", [lexical.QUERY_TERMS, 20])
def test_search_equals_plain_scores(spark, limit):
    docs, items = make_corpus(random.Random(limit), 400)
    docs += [(None, "w3 w4 w5"), (None, None), (7, "w3 w4 w5"), (7, "w3 w4 w5"), (900, ""), (901, "., !")]
    docs += [(1000 + k, docs[5][1]) for k in range(120)] + [(2000, "w1 w2 " * 200_000)]
    items += [(50, None), (None, "w3"), (51, "nowhere"), (52, ""), (3, "w3 W3 w3;w4")]
    got = lexical.search(*tables_of(spark, docs, items), query_terms=limit).collect()
    assert Counter(map(tuple, got)) == Counter(plain_scores(docs, items))


def test_search_of_empty_tables(spark):
    docs, items = tables_of(spark, [(1, "w1 w2"), (2, "w1"), (3, "z")], [(1, "w2")])
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id = 9"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_and_bounds_lose_nothing(monkeypatch):
    """Small blocks in one process: running scores and pair bounds give what a plain sort gives."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 17)
    for seed in range(6):
        docs, items = make_corpus(random.Random(seed), 300)
        number = {}
        queries = [[number.setdefault(t, len(number)) for t in dict.fromkeys(plain_terms(text))] for _, text in items]
        words = {t.encode(): k for t, k in number.items()}
        batches = [
            pa.record_batch({"id": [d[0] for d in part], "text": [d[1] for d in part]})
            for part in (docs[:1], docs[1:150], docs[150:])
        ]
        made = list(lexical._postings(SimpleNamespace(value=words))(iter(batches)))
        lengths = np.concatenate([b.column(1).to_numpy() for b in made])
        n, total = int((lengths > 0).sum()), int(lengths.sum())
        held = Counter(t for b in made for row in b.column(2).to_pylist() for t in row)
        weights = np.array([lexical.weight(n, held[k]) for k in range(len(number))], np.int64)
        pairs = lexical.listed_pairs(queries, weights)
        partners = {}
        for a, b in pairs:
            partners.setdefault(a, []).append(b)
        found = [row for out in lexical._maxima(SimpleNamespace(value=(weights, partners)), n, total)(iter(made))
                 for row in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        most = {(a, b): m for a, b, _, m in found}
        # Joint maxima are those of the intersections.
        bags = {d: Counter(plain_terms(t)) for d, t in docs}
        names = {k: t for t, k in number.items()}
        for a, b, shared, _ in found:
            if b >= 0:
                assert shared == sum(1 for bag in bags.values() if names[a] in bag and names[b] in bag)
        plans = [lexical.combine(q, lexical.listed_pairs([q], weights), most) for q in queries]
        singles = [sum(most.get((t, -1), 0) for t in q) for q in queries]
        assert all(p.upto[-1] <= s for p, s in zip(plans, singles, strict=True))
        assert any(p.upto[-1] < s for p, s in zip(plans, singles, strict=True))
        k = 5
        run = lexical._search(SimpleNamespace(value=(weights, plans)), n, total, k, pa.int64())
        got = Counter((r["q"], r["id"], r["score"]) for out in run(iter(made)) for r in out.to_pylist())
        want = Counter((q, d, s) for q, rank, d, s in plain_scores(docs, items) if rank <= k)
        assert got == want
