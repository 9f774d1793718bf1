"""Operators on documents against brute force, on edge cases and on the small given table."""

import base64
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vicinia.llm import bpe, language, mixing, near, pii, rules, shards, substring
from vicinia.llm.queries import public_vocabulary

GIVEN = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string"


def docs_of(spark, texts, sources=None, ids=None):
    """Documents with two extra columns whose names clash with results."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [
        (i, t, "en", s, None if t is None else len(t), 0.5, "x") for i, t, s in zip(ids, texts, sources, strict=True)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(dice, n, types=400):
    return " ".join(f"w{dice.randrange(types)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(4)
    base = [prose(dice, dice.randint(30, 200)) for _ in range(30)]
    passage = prose(dice, 45)
    out = [None, "", "   \n\t", "one", "two words", "Ärger é日本 \x00\x0b x y"]
    out += base + base[:6]
    for text in base[:12]:
        w = text.split()
        w[dice.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(dice, 40)} {passage} {prose(dice, 20)}" for _ in range(8)]
    out += ["same " * 90, "same " * 70, "a b c " * 30, prose(dice, 6000, 5000)]
    out += [out[-1].upper(), " ".join(["tail", *base[3].split()])]
    return out


# ---- near duplicates ---------------------------------------------------------


def brute_near(rows, threshold):
    sets = {}
    for i, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = words_of(w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= threshold * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_matches_brute_force(spark, texts, threshold):
    got = near_rows(near.near_duplicates(docs_of(spark, texts), threshold=threshold))
    assert got == brute_near(list(enumerate(texts)), threshold)


def test_near_chains_of_copies(spark):
    """Links between documents that are not linked with the first of their list are found."""
    dice = random.Random(9)
    base = prose(dice, 120, 10_000).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 6):
            w[dice.randrange(len(w))] = f"n{dice.randrange(40)}"
        rows.append((1000 - k, " ".join(w)))
    got = near_rows(near.near_duplicates(docs_of(spark, [t for _, t in rows], ids=[i for i, _ in rows])))
    assert got == brute_near(rows, 85)


def template(dice, n, length):
    """Texts of one form, in which every fifth word is one of two, and the ends differ."""
    form = prose(dice, length, 10_000).split()
    texts = []
    for _ in range(n):
        words = [w if k % 5 else f"{w}{dice.randrange(2)}" for k, w in enumerate(form)]
        texts.append(" ".join(words[: dice.randrange(length * 2 // 3, length + 1)]))
    return texts


def test_near_lists_of_many_blocks(spark, monkeypatch):
    """Lists of many times the size of a block lose no link."""
    monkeypatch.setattr(near, "BLOCK", 8)
    dice = random.Random(21)
    texts = template(dice, 90, 60)
    # Nearly equal ones of several stems, linked with each other but not with the first of their lists.
    for stem in texts[:12]:
        for _ in range(6):
            words = stem.split()
            words[dice.randrange(len(words))] = f"x{dice.randrange(9)}"
            texts.append(" ".join(words))
    for threshold in (60, 85):
        got = near_rows(near.near_duplicates(docs_of(spark, texts), threshold=threshold))
        assert got == brute_near(list(enumerate(texts)), threshold)


def test_near_block_pairs_are_bounded_and_complete(spark, monkeypatch):
    """Every pair that sizes allow meets once, outside the commonest component; no group grows with its list."""
    monkeypatch.setattr(near, "BLOCK", 16)
    dice = random.Random(4)
    rows = [(v, i, dice.choice([1, 1, 1, 2, 3, 4 + i]), dice.randrange(20, 60)) for v, n in ((7, 600), (8, 12)) for i in range(n)]
    labelled = spark.createDataFrame(rows, "value long, id long, component long, n long")
    groups = {}
    for r in near.block_pairs(labelled, 85).collect():
        groups.setdefault((r.value, r.block), []).append(r)
    assert max(len(g) for g in groups.values()) <= 4 * 16
    met = []
    for (value, _), group in groups.items():
        for a in group:
            for b in group:
                ordered = a.side != near.RIGHT and b.side != near.LEFT
                if ordered and a.id != b.id and not (a.side == b.side == near.BOTH and a.id > b.id):
                    met.append((value, min(a.id, b.id), max(a.id, b.id)))
    assert len(met) == len(set(met))
    main = {v: max({1, 2, 3}, key=lambda c: sum(r[0] == v and r[2] == c for r in rows)) for v in (7, 8)}
    wanted = {
        (a[0], a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and not a[2] == b[2] == main[a[0]] and 100 * min(a[3], b[3]) >= 85 * max(a[3], b[3])
    }
    assert wanted <= set(met)
    assert len([m for m in met if m[0] == 7]) < 600 * 599 // 2


def test_near_nulls_and_repeats(spark):
    copy = "a b c d e f g h"
    df = docs_of(spark, [copy, copy, copy, None], ids=[None, 5, 5, None])
    got = sorted((tuple(r) for r in near.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (5, 4, None, False), (5, 4, None, False), (None, 0, None, True)], key=str)
    assert near.near_duplicates(docs_of(spark, [])).count() == 0


def test_sketches_never_lose_small_sets():
    for n in range(1, 55):
        assert near.least_overlap(n, 64, 85) == -(-85 * n // 100)
    assert 30 < near.least_overlap(5000, 64, 85) < 54


@pytest.mark.parametrize("threshold", [80, 85])
def test_sketches_lose_less_than_one_link_in_a_million(threshold):
    share = threshold / 100
    chance = lambda n, k: math.comb(n, k) * share**k * (1 - share) ** (n - k)
    # A set inside the other, and the estimate on longer sketches: the exact chance to fall below the margin.
    lost = sum(chance(near.SKETCH, k) for k in range(near.least_overlap(5000, near.SKETCH, threshold)))
    far = [k for k in range(near.LONG_SKETCH) if not near.may_reach(k, near.LONG_SKETCH, threshold)]
    assert lost < 1e-6 and sum(chance(near.LONG_SKETCH, k) for k in far) < 1e-6


# ---- repeated passages -------------------------------------------------------


def brute_repeats(rows):
    first, gone = {}, {}
    parsed = {i: words_of(t) for i, t in rows}
    for i in sorted(parsed):
        w = parsed[i]
        gone[i] = set()
        for k in range(len(w) - 19):
            run = tuple(w[k : k + 20])
            if run in first:
                gone[i].update(range(k, k + 20))
            else:
                first[run] = (i, k)
    return {
        i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in parsed.items()
    }


def test_repeats_match_brute_force(spark, texts):
    got = {r[0]: tuple(r[1:]) for r in substring.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_repeats_of_periodic_texts(spark):
    dice = random.Random(2)
    rows = [" ".join("ab"[dice.randrange(2)] for _ in range(dice.randint(0, 120))) for _ in range(40)]
    rows += [("x y z " * 40) + "end", ("y z x " * 30), "p " * 300]
    got = {r[0]: tuple(r[1:]) for r in substring.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == brute_repeats(list(enumerate(rows)))


def test_repeats_nulls_and_repeats(spark):
    dice = random.Random(5)
    run = prose(dice, 30)
    df = docs_of(spark, [run, run, run, None], ids=[None, 7, 7, 8])
    got = sorted((tuple(r) for r in substring.remove_repeats(df).collect()), key=str)
    assert got == sorted([(None, 30, 0, run), (7, 30, 30, ""), (7, 30, 30, ""), (8, 0, 0, "")], key=str)
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0
    digest = {r[0]: r[3] for r in substring.remove_repeats(df, digest=True).collect()}
    assert digest[None] == hashlib.sha256(run.encode()).hexdigest()


@pytest.mark.parametrize("row_id", [None, 7])
def test_repeats_of_one_id_and_very_unequal_lengths(spark, row_id):
    dice = random.Random(6)
    run, other = prose(dice, 30, 10_000), prose(dice, 25, 10_000)
    # A slice of its own, with the shared passage far beyond the other text's end.
    long = " ".join([*(f"u{k}" for k in range(450_000)), run])
    df = docs_of(spark, [run, long, other], ids=[row_id] * 3)
    got = {r["n_words"]: (r["doc_id"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(df).collect()}
    assert got[25] == (row_id, 0, other)
    # Documents of equal ID are ordered by a hash: either has the first occurrence.
    first = [(row_id, 0, run), (row_id, 30, long[: -len(run) - 1])]
    second = [(row_id, 30, ""), (row_id, 0, long)]
    assert [got[30], got[450_030]] in (first, second)


# ---- byte-level BPE ----------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, texts, reference_encoding):
    dice = random.Random(3)
    more = ["".join(chr(dice.choice([dice.randint(1, 0xD7FF), dice.randint(97, 122)])) for _ in range(99)) for _ in range(20)]
    rows = [*texts, *more, "a" * 3000, "abab" * 500, "<|endoftext|>", "it's  we'll\n\n x"]
    words = public_vocabulary()
    coded = bpe.encode(docs_of(spark, rows), words, round_trip=True)
    seen = 0
    for r in coded.collect():
        ids = reference_encoding.encode_ordinary(rows[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r["decoded"]) == (rows[r["doc_id"]] or "").encode()
        seen += 1
    assert seen == len(rows)
    back = bpe.decode(coded.select("doc_id", "ids"), words)
    assert all(bytes(r["decoded"]) == (rows[r["doc_id"]] or "").encode() for r in back.collect())
    assert bpe.encode(docs_of(spark, []), words).count() == 0


def test_bpe_redoes_pieces_out_of_rank_order(tmp_path):
    """A merge that makes a pair of lower rank, which trained vocabularies do not have."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    encoder = bpe.Encoder(bpe.vocabulary(str(path), r"[a-z]+"))
    for word in (b"abc", b"abcc", b"aabcc", b"bcabcbc", b"ccccc", b"ababcabcc"):
        ids, _ = encoder.replay([word])
        assert ids.tolist() == encoder.one(word)


# ---- language ----------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(GIVEN.replace("0.001", "0.01"))
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    fold = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in got if r["held_out"]} == {r["doc_id"] for r in fold}
    assert sum(r["lang_pred"] == r["lang"] for r in fold) >= 0.97 * len(fold)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_language_edge_cases(spark):
    rows = ["the of and the of and"] * 30 + [None, "", "1234 !? \n", "é", "日本", "x" * 70_000]
    df = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert [got[k]["lang_pred"] for k in (30, 31, 32)] == ["und"] * 3
    assert all(got[k]["rejected"] and got[k]["score"] == 0 for k in (30, 31, 32))
    assert [got[k]["lang_pred"] for k in (0, 33, 34, 35)] == ["en"] * 4
    none = language.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(docs_of(spark, [])).count() == 0


# ---- personal data -----------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text):
    def valid(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == 1:
            return all(int(p) <= 255 for p in match.split("."))
        if kind == 2:
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    found = [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(k, m[0])]
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_spans_match_patterns():
    dice = random.Random(8)
    for _ in range(20_000):
        text = "".join(dice.choice("ab@@..-+ 0123456789()é\n") for _ in range(dice.randint(0, 50)))
        assert pii.base_spans(text) == brute_spans(text)


def test_personal_data(spark):
    rows = [
        None, "", "plain words only", "é mail ann.b@x.example.org, 10.0.0.255 or +1 (555) 123-4567",
        "4111 1111 1111 1111 and 4111 1111 1111 1112", "build 1.2.3.4567 of 2024-01-02 at 12:30",
    ] * 2
    given = spark.read.parquet(GIVEN.replace("0.001", "0.01"))
    df = docs_of(spark, rows)
    model = pii.train(given)
    got = {r["doc_id"]: r for r in pii.detect(df, model, redacted="clean").collect()}
    for k, text in enumerate(rows):
        spans = brute_spans(text or "")
        assert got[k]["base"] == pii.joined(spans)
        assert [got[k][f"n_{n}"] for n in pii.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert set(filter(None, got[k]["base"].split(","))) <= set(filter(None, got[k]["spans"].split(",")))
    assert got[3]["clean"] == "é mail <EMAIL>, <IP> or <PHONE>" and got[0]["clean"] is None
    assert got[2]["spans"] == got[5]["spans"] == ""
    assert pii.detect(docs_of(spark, []), pii.train(docs_of(spark, []))).count() == 0


def test_trees_find_written_out_forms(spark):
    model = pii.train(spark.read.parquet(GIVEN.replace("0.001", "0.01")))
    _, added = pii.find("mail me: john.doe [at] mail [dot] com now", model)
    assert [s[0] for s in added] == [pii.EMAIL]
    assert pii.find("call (555) 123-4567 now", model)[1]
    assert not pii.find("paid 1,234,567 on 2024-01-02, version 1.2.3.4567", model)[1]


def test_numbers_beside_others_are_proposed():
    def phones(text):
        return {text[a:b] for kind, a, b in pii.proposals(text) if kind == pii.PHONE}

    assert {"555-123-4567", "555-987-6543"} <= phones("555-123-4567, 555-987-6543")
    assert "555-123-4567" in phones("2024-01-15 555-123-4567")
    assert "5551234567" in phones("5551234567, 12 Main")
    assert "(555) 123-4567" in phones("no 7 (555) 123-4567, 12th floor")
    assert "555-123-4567" in phones("ann,555-123-4567,x") and not phones("a5551234567 5551234567b")
    # At most 19 parts end with a group.
    assert len(list(pii.proposals("1 " * 10_000))) < 3 * 19 * 10_000


def test_numbers_beside_others_are_found(spark):
    model = pii.train(spark.read.parquet(GIVEN.replace("0.001", "0.01")))
    for text in ("555-123-4567, 555-987-6543", "2024-01-15 555-123-4567", "log 12, (555) 123-4567, 34 x"):
        got = {text[a:b] for kind, a, b in pii.find(text, model)[1] if kind == pii.PHONE}
        assert got == set(re.findall(r"\(?555\)?[ -]\d{3}-\d{4}", text)), text


def test_common_notations_do_not_count_as_errors(spark):
    dice = random.Random(9)
    number = lambda: [f"{dice.randrange(10 ** n):0{n}}" for n in (3, 3, 4)]
    rows = []
    for k in range(600):
        a, b, c = number()
        rows.append(f"item {k} call ({a}) {b}-{c} or mail w{a} [at] host{b}.org now")
        if k % 3 == 0:
            rows.append(f"item {k} call +1 {a} {b} {c} or mail w{b}@host{c}.org now")
    df = docs_of(spark, rows)
    model = pii.train(df)
    for k in range(50):
        a, b, c = number()
        text = f"item {k} call ({a}) {b}-{c} or mail w{a} [at] host{b}.org now"
        got = {(kind, text[x:y]) for kind, x, y in pii.find(text, model)[1]}
        assert got == {(pii.PHONE, f"({a}) {b}-{c}"), (pii.EMAIL, f"w{a} [at] host{b}.org")}


def test_kinds_without_base_spans_are_found(spark):
    model = pii.train(docs_of(spark, ["plain words only", "12 of 34"]))
    assert set(model) == set(range(4))
    assert [s[0] for s in pii.find("call (555) 123-4567 today", model)[1]] == [pii.PHONE]
    assert not pii.find("paid 1,234,567 on 2024-01-02, version 1.2.3.4567", model)[1]


# ---- mixing ------------------------------------------------------------------


def brute_mix(rows):
    sized = [(i, s, len(words_of(t))) for i, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        goal = {s: weight[s] * left / max(1, sum(weight[f] for f in free)) for s in free}
        over = {s for s in free if weight[s] * left > 3 * sizes[s] * sum(weight[f] for f in free)}
        if not over:
            break
        fixed |= over
    goal |= {s: 3.0 * sizes[s] for s in fixed}
    return sized, sizes, goal


def check_mix(spark, texts, sources):
    df = docs_of(spark, texts, sources)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect()))
    sized, sizes, goal = brute_mix(list(zip(range(len(texts)), texts, sources, strict=True)))
    taken = {}
    for r in got:
        _, source, size = sized[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source])
        assert r["target"] == pytest.approx(goal[source], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * size
        taken[source] = taken.get(source, 0) + r["taken"]
    assert len(got) == len(texts)
    assert all(taken[s] == int(goal[s] + 1e-9) for s in sizes)


def test_mix_reaches_targets(spark, texts):
    check_mix(spark, texts, [["a", "b", "Z", None, "é"][i * i % 5] for i in range(len(texts))])


def test_mix_of_a_hot_and_many_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    dice = random.Random(6)
    texts = [prose(dice, dice.randint(0, 30)) for _ in range(120)]
    check_mix(spark, texts, ["hot" if i % 3 else f"s{i}" for i in range(120)])
    check_mix(spark, ["", None], ["a", None])
    assert mixing.mix(docs_of(spark, [])).count() == 0


# ---- quality rules -----------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {p for k, r in enumerate(runs) if runs.count(r) > 1 for p in range(k, k + 3)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def test_measures_match_brute_force(spark, texts):
    rows = [*texts[:60], "x # y\nx # y\n\n \nx # y", "a b c a b c d | <b>", "é é é é"]
    got = rules.judge(docs_of(spark, rows)).collect()
    for r in got:
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert own == brute_measures(rows[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1
    assert len(got) == len(rows)
    assert rules.judge(docs_of(spark, [])).count() == 0


def test_verdicts_agree_with_labels(spark):
    folder = GIVEN.replace("0.001", "0.01")
    got = rules.judge(spark.read.parquet(folder)).join(
        spark.read.parquet(folder.replace("documents", "labels")), "doc_id"
    ).where("n_words >= 50").collect()
    good = [r["kept"] for r in got if r["quality"] is not None and r[-2] == 1]
    bad = [r["kept"] for r in got if r[-2] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_estimates_by_hand(spark):
    """Expectation maximisation over given patterns, against plain Python."""
    dice = random.Random(1)
    names = [r.name for r in rules.RULES]
    patterns = [([dice.choice([-1, 0, 1, 1]) for _ in names], dice.randint(1, 50)) for _ in range(40)]
    df = spark.createDataFrame(
        [(*v, n) for v, n in patterns], ", ".join(f"vote_{x} int" for x in names) + ", n bigint"
    )
    classes, own = range(len(names) + 1), rules.start()
    for _ in range(rules.ROUNDS):
        chance = []
        for votes, _ in patterns:
            weights = [own.shares[c] for c in classes]
            for c in classes:
                for k, vote in enumerate(votes):
                    weights[c] *= own.rates[c][k][vote + 1]
            chance.append([w / sum(weights) for w in weights])
        sizes = [sum(n * p[c] for (_, n), p in zip(patterns, chance, strict=True)) for c in classes]
        rates = []
        for c in classes:
            rates.append([])
            for k in range(len(names)):
                cast = [0.0] * 3
                for (votes, n), p in zip(patterns, chance, strict=True):
                    cast[votes[k] + 1] += n * p[c]
                before = rules.start().rates[c][k]
                rates[-1].append(tuple((x + 2 * y) / (sizes[c] + 2) for x, y in zip(cast, before, strict=True)))
        shares = [(x + 2 * y) / (sum(sizes) + 2) for x, y in zip(sizes, rules.start().shares, strict=True)]
        moved = max(abs(a - b) for a, b in zip(shares, own.shares, strict=True))
        own = rules.Estimates(tuple(shares), tuple(map(tuple, rates)))
        if moved < rules.CLOSE_ENOUGH:
            break
    got = rules.estimate(df)
    assert got.shares == pytest.approx(own.shares, abs=1e-9)
    assert all(x == pytest.approx(y, abs=1e-9) for a, b in zip(got.rates, own.rates, strict=True) for x, y in zip(a, b, strict=True))


# ---- sharding ----------------------------------------------------------------


def test_lookup_table_is_filled_by_turns():
    names = ["a", "b", "c", "d", "e"]
    table = shards.lookup_table(names, 101)
    slow, spots = [None] * 101, [shards._numbers(n, 101) for n in names]
    steps, turn = [0] * 5, 0
    while None in slow:
        start, step = spots[turn]
        while slow[(start + steps[turn] * step) % 101] is not None:
            steps[turn] += 1
        slow[(start + steps[turn] * step) % 101] = turn
        turn = (turn + 1) % 5
    assert table.tolist() == slow
    counts = [slow.count(k) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    gone = shards.lookup_table(names[:-1], 101)
    stayed = sum(names[a] == names[b] for a, b in zip(table, gone, strict=True) if a != 4)
    assert stayed >= 0.7 * (101 - slow.count(4))
    heavy = shards.lookup_table(names, 1009, [4, 1, 1, 1, 1]).tolist()
    assert heavy.count(0) > 3 * heavy.count(1)
    for wrong in ((names, 100), ([], 101), (["a", "a"], 101)):
        with pytest.raises(ValueError):
            shards.lookup_table(*wrong)


def test_places(spark, tmp_path):
    df = docs_of(spark, ["x"] * 60 + [None], ids=[*range(50), *[7] * 10, None]).withColumn("shard", F.lit("old"))
    names = ["north", "south", "east"]
    got = shards.place(df, ["doc_id"], names, size=101).collect()
    table = shards.lookup_table(names, 101)
    assert len(got) == 61 and all(r["shard"] == names[table[r["slot"]]] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert {r["doc_id"]: r["shard"] for r in got} == {
        r["doc_id"]: r["shard"] for r in shards.place(df, ["doc_id"], names, size=101).collect()
    }
    spread = shards.place(
        spark.range(500).withColumn("key", F.lit("hot")), ["key"], names, size=101, spread=("id", 16)
    )
    assert spread.select("shard").distinct().count() == 3
    shards.write(shards.place(df, ["doc_id"], names, size=101), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 61
    assert shards.place(docs_of(spark, []), ["doc_id"], names).count() == 0
