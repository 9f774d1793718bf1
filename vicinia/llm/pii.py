"""Personal data: candidates of high recall, judged by boosted trees.

Four kinds are looked for: e-mail and IP addresses, card and phone numbers. Spans
that follow the base rules exactly are always reported. Generators propose more,
which may overlap: addresses with a written-out at sign, and of every run of
digits with separators each part between two borders of its groups of digits, as
each kind its digits allow; so numbers that stand side by side are all seen. For
each kind, gradient-boosted trees of depth two judge a proposal by its format and
its neighbourhood; it is added if its score reaches a threshold calibrated to
``PRECISION`` on proposals left out of the training, and if it touches no base
span and no better addition.

The trees are trained here. About ``sample_documents`` documents, chosen by a hash
of the ID, are read in the tasks; each base span in them yields a row of features
for itself and for rewritten forms of it (without plus sign, other separators,
obscured at sign), and look-alikes in the same place (wrong check digits, large
address parts, version numbers, dates, amounts, parts of a number, numbers run
together) are the other class, together with at most ``NATURAL`` proposals of each
text that fail the digit rules of their kind. Other proposals of the texts may be
personal data in another notation, so they are of neither class. Thresholds count
rewritten forms and look-alikes only, without the base spans. Only these rows of
numbers, at most ``SAMPLE_ROWS``, reach the driver. A kind with fewer than
``LEAST_SPANS`` base spans among them is trained on made-up ones as well.

Defined results: a null or empty text has no spans; offsets count code points and
ends are exclusive; equal texts have equal spans; an empty table gives an empty
result. Texts of any length are read whole, in time linear in their length. Only
the named columns are read; result columns of the same name are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE_DOCUMENTS = 20_000
SAMPLE_ROWS = 40_000
PRECISION = 0.98
ROUNDS, RATE, BINS = 40, 0.3, 16
#: Characters before and after a span that count as its neighbourhood.
AROUND = 24
#: A local part or domain longer than this is no proposal (the base rule has no such limit).
LONGEST_NAME = 64
#: No kind has more digits.
MOST_DIGITS = 19
#: Proposals judged at once, parts of a form and other proposals of a text that are training rows.
JUDGED, PARTS, NATURAL = 4096, 6, 20
LEAST_SPANS = 200

Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive, and from the start of a run of digits only: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.IGNORECASE)
_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.IGNORECASE)
_RIGHT = re.compile(r" ?[\w-]{1,64}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]{1,64})+", re.IGNORECASE)
_LEFT = re.compile(r"[\w.%+-]{1,64} ?\Z")
_GROUP = re.compile(r"[0-9]+")
#: One or two of these join groups of digits.
_BETWEEN = " ().,/-"
_HINTS = (
    re.compile(r"mail|contact|@|write", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|addr", re.IGNORECASE),
    re.compile(r"card|visa|credit|kart|carte|tarjeta|pay", re.IGNORECASE),
    re.compile(r"phone|call|\btel|mobil|fax|cell|tél", re.IGNORECASE),
    re.compile(r"version|\bv\b|order|invoice|number|\bno\b|id\b|date|total|isbn|serial", re.IGNORECASE),
)


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans ``(kind, start, end)`` of the base rules."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (match := _DOMAIN.match(text, at + 1)):
            done = match.end()
            out.append((EMAIL, first, done))
        at = text.find("@", max(at + 1, done))
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match[0].split(".")):
            out.append((IP, *match.span()))
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
                out.append((PHONE, *match.span()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, end, digits)`` of all parts of runs of digits that begin and end with a whole group.

    No more than ``MOST_DIGITS`` parts end with a group, so they are in proportion to the text.
    """
    last, parts = 0, []
    for match in _GROUP.finditer(text):
        begin, end = match.span()
        if begin - last > 2 or text[last:begin].strip(_BETWEEN):
            parts = []
        if not begin or not _is_word(text[begin - 1]):
            first = begin
            while first and begin - first < 2 and text[first - 1] in "+(":
                first -= 1
            parts.append((first, 0))
        parts = [(a, n + end - begin) for a, n in parts if n + end - begin <= MOST_DIGITS]
        if end == len(text) or not _is_word(text[end]):
            for a, n in parts:
                yield a, end, n
        last = end


def proposals(text: str) -> Iterator[Span]:
    """Spans that may be personal data; they may overlap."""
    for match in _AT.finditer(text):
        left = _LEFT.search(text, max(0, match.start() - LONGEST_NAME - 1), match.start())
        right = _RIGHT.match(text, match.end() + (text[match.end() : match.end() + 1] == " " and match[0] != "@"))
        if left and right:
            yield EMAIL, left.start(), right.end()
    for a, b, n in numbers(text):
        if 12 <= n <= MOST_DIGITS:
            yield CARD, a, b
        if 7 <= n <= 15:
            yield PHONE, a, b
        if 4 <= n <= 15 and text.count(".", a, b) + text.count(",", a, b) == 3:
            yield IP, a, b


def features(kind: int, span: str, before: str, after: str) -> list[float]:
    """Numbers that describe a span's format and neighbourhood."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    around = before + " " + after
    nearest = before[-1:] or " "
    following = after[:1] or " "
    tail = re.split(r"[.\])]", span)[-1].strip()
    return [
        len(span), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        span.count(" "), span.count("-"), span.count("."), span.count(","), span.count("/"),
        span.count("(") + span.count("["), float(span.startswith("+")), float("@" in span),
        float(kind == CARD and luhn(digits)),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(digits[:1] in "3456"), float(nearest.isalnum()), float(nearest in " \n\t"),
        float(following.isalnum()), float(following in " \n\t,;"),
        float(len(tail)), float(tail.isalpha()), *[float(bool(h.search(around))) for h in _HINTS],
    ]


def rewritten(kind: int, span: str, dice: random.Random) -> list[tuple[str, int]]:
    """Other forms of a base span (1), and look-alikes that are none (0)."""
    digits = re.sub(r"[^0-9]", "", span)
    pick = lambda n: "".join(dice.choice("0123456789") for _ in range(n))
    if kind == EMAIL:
        name, _, place = span.partition("@")
        obscured = place.replace(".", " [dot] ")
        return [
            (f"{name} [at] {place}", 1), (f"{name}(at){place}", 1), (f"{name} [at] {obscured}", 1),
            (f"{name}@{pick(1)}.{pick(1)}", 0), (f"{name} (at) {pick(2)}.{pick(2)}", 0),
            (f"{name} (at) {place.partition('.')[0]}. Then", 0),
        ]
    if kind == IP:
        parts = span.split(".")
        wide = [str(dice.randint(256, 999)), *parts[1:]]
        return [(",".join(parts), 1), (".".join(wide), 0), (f"{pick(1)}.{pick(4)}.{pick(1)}.{pick(5)}", 0)]
    if kind == CARD:
        grouped = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + dice.randint(1, 9)) % 10)
        other = [wrong[i : i + 4] for i in range(0, len(wrong), 4)]
        return [
            (".".join(grouped), 1), ("/".join(grouped), 1), (wrong, 0), (" ".join(other), 0), (".".join(other), 0),
            (pick(4) + "/" + pick(2) + "/" + pick(2) + " " + pick(6), 0),
        ]
    rest = digits[-10:]
    # Nine digits at least, in the groups people write; bare runs are numbers of another kind.
    return [
        (f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", 1), (f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", 1),
        (f"00{digits[:-10]} {rest[:3]} {rest[3:6]} {rest[6:]}", 1), (pick(len(rest)), 0),
        (f"20{pick(2)}-{pick(2)}-{pick(2)} {pick(2)}", 0), (f"{pick(3)},{pick(3)},{pick(3)}", 0),
        (f"{pick(5)}.{pick(5)}", 0), (f"{pick(2)}/{pick(2)}/{pick(4)}", 0), (f"{pick(1)}-{pick(4)}-{pick(4)}-{pick(1)}", 0),
        (f"978-{pick(1)}-{pick(2)}-{pick(6)}-{pick(1)}", 0), (f"{pick(1)},{pick(3)},{pick(3)}.{pick(2)}", 0),
        (f"{pick(4)}-{pick(4)}, {pick(4)}", 0), (f"{pick(4)} {pick(4)} {pick(4)}", 0),
    ]


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - AROUND) : start], text[end : end + AROUND]


def fails(kind: int, span: str) -> bool:
    """Whether a proposal breaks the rules of its kind about digits, in any notation."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    if kind == CARD:
        return not luhn(digits)
    if kind == PHONE:
        return not 9 <= len(digits) <= 15
    if kind == IP:
        return len(groups) != 4 or any(len(g.lstrip("0")) > 3 or int(g) > 255 for g in groups)
    return re.split(r"[.\])]", span)[-1].strip().isdecimal()


#: Kind, label, whether it is no base span, and features.
Row = tuple[int, int, int, list[float]]


def _beside(kind: int, form: str, before: str, after: str, dice: random.Random) -> list[Row]:
    """Training rows of a number beside others: itself, and parts of it or with a neighbour, which are none."""
    pick = lambda n: "".join(dice.choice("0123456789") for _ in range(n))
    date = f"20{pick(2)}-{pick(2)}-{pick(2)}"
    before += dice.choice(("", f"{pick(2)} ", f"{pick(1)}, ", f"{date} ", f"{pick(3)},", f"{form}, ", f"{form} "))
    after = dice.choice(("", f", {pick(2)} ", f" {pick(4)} ", f" {date}", f",{pick(3)}", f", {form}", f" {form}")) + after
    text, a, b = before + form + after, len(before), len(before) + len(form)
    found = []
    for other, x, y in proposals(text):
        # Nine digits within a number with a prefix may be a number themselves.
        whole = other == kind == PHONE and a <= x and y <= b and sum(map(str.isdecimal, text[x:y])) >= 9
        if other != EMAIL and x < b and a < y and not whole and (other, x, y) != (kind, a, b):
            found.append((other, x, y))
    some = dice.sample(found, min(PARTS, len(found)))
    rows = [(other, 0, 1, features(other, text[x:y], *_around(text, x, y))) for other, x, y in some]
    return [(kind, 1, 1, features(kind, form, *_around(text, a, b))), *rows]


def examples(text: str) -> list[Row]:
    """Training rows of a text."""
    out = []
    spans = base_spans(text)
    taken = _Taken(spans)
    # The same text gives the same rows in every run.
    dice = random.Random(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())
    for kind, a, b in spans:
        before, after = _around(text, a, b)
        out.append((kind, 1, 0, features(kind, text[a:b], before, after)))
        for form, label in rewritten(kind, text[a:b], dice):
            out.append((kind, label, 1, features(kind, form, before, after)))
            if label and kind != EMAIL:
                out += _beside(kind, form, before, after, dice)
    # Of the proposals that cannot be of their kind a few, each with the same chance.
    kept: list[Span] = []
    wrong = (p for p in proposals(text) if not taken.touch(*p[1:]) and fails(p[0], text[p[1] : p[2]]))
    for seen, span in enumerate(wrong):
        if seen < NATURAL:
            kept.append(span)
        elif (k := dice.randrange(seen + 1)) < NATURAL:
            kept[k] = span
    return out + [(kind, 0, 1, features(kind, text[a:b], *_around(text, a, b))) for kind, a, b in kept]


_NEIGHBOURS = (
    ("", ""), ("see ", ", or later"), ("it is ", "."), ("call ", " today"), ("contact: ", "\n"), ("host ", " is down"),
    ("pay by card ", " now"), ("a, ", ", b"), ("write to ", " or not"), ("order ", " of the list"), ("(", ")"),
)


def made_up(kind: int) -> list[Row]:
    """Training rows of base spans that no corpus has."""
    dice = random.Random(kind)
    pick = lambda n, of="0123456789": "".join(dice.choice(of) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    out: list[Row] = []
    for _ in range(LEAST_SPANS):
        card = dice.choice("3456") + pick(14)
        card += next(d for d in "0123456789" if luhn(card + d))
        span = (
            f"{pick(dice.randint(1, 8), letters)}.{pick(6, letters)}@{pick(dice.randint(2, 9), letters)}.{pick(3, letters)}",
            ".".join(str(dice.randint(0, 255)) for _ in range(4)),
            dice.choice((card, " ".join(card[k : k + 4] for k in range(0, 16, 4)))),
            f"+{dice.randint(1, 99)} {pick(3)} {pick(3)} {pick(4)}",
        )[kind]
        before, after = dice.choice(_NEIGHBOURS)
        out += [row for row in examples(before + span + after) if row[0] == kind]
    return out


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two: per tree three splits and four leaves."""

    column: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray
    start: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for column, edge, leaf in zip(self.column, self.edge, self.leaf, strict=True):
            top = x[:, column[0]] > edge[0]
            low = np.where(top, x[:, column[2]] > edge[2], x[:, column[1]] > edge[1])
            total += leaf[2 * top + low]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_split(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float]:
    best, found = -1.0, (0, np.inf)
    total, weight = slope.sum(), bend.sum()
    for column, cuts in enumerate(edges):
        if not len(cuts):
            continue
        place = np.searchsorted(cuts, x[:, column], "left")
        left = np.cumsum(np.bincount(place, slope, len(cuts) + 1))[:-1]
        mass = np.cumsum(np.bincount(place, bend, len(cuts) + 1))[:-1]
        gain = left**2 / (mass + 1) + (total - left) ** 2 / (weight - mass + 1)
        k = int(np.argmax(gain))
        if gain[k] > best + 1e-12:
            best, found = float(gain[k]), (column, float(cuts[k]))
    return found


def boost(x: np.ndarray, y: np.ndarray, added: np.ndarray) -> Trees | None:
    """Logistic boosting; every fourth row is left out. None without both classes.

    Those left out that may be ``added``, being no base spans, set the threshold.
    """
    held = np.arange(len(y)) % 4 == 3
    judged = held & added
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[judged].sum()) < 5:
        return None
    own, truth = x[~held], y[~held]
    edges = []
    for column in range(x.shape[1]):
        cuts = np.unique(np.quantile(own[:, column], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(cuts[cuts < own[:, column].max()])
    share = truth.mean()
    start = float(np.log(share / (1 - share)))
    total = np.full(len(truth), start)
    columns, cuts, leaves = [], [], []
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = truth - chance, chance * (1 - chance)
        top = _best_split(own, slope, bend, edges)
        right = own[:, top[0]] > top[1]
        sides = [_best_split(own[m], slope[m], bend[m], edges) if m.any() else (0, np.inf) for m in (~right, right)]
        low = np.where(right, own[:, sides[1][0]] > sides[1][1], own[:, sides[0][0]] > sides[0][1])
        place = 2 * right + low
        leaf = RATE * np.bincount(place, slope, 4) / (np.bincount(place, bend, 4) + 1)
        total += leaf[place]
        columns.append([top[0], sides[0][0], sides[1][0]])
        cuts.append([top[1], sides[0][1], sides[1][1]])
        leaves.append(leaf)
    trees = Trees(np.array(columns), np.array(cuts), np.array(leaves), start, 1.0)
    scores, truth = trees.score(x[judged]), y[judged]
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(scores[order]) != 0, True)
    good = np.flatnonzero((right >= PRECISION) & last)
    # Without a threshold of that precision, nothing is added.
    threshold = float(max(0.5, scores[order][good[-1]])) if len(good) else 2.0
    return Trees(trees.column, trees.edge, trees.leaf, start, threshold)


Model = dict[int, Trees]


def train(
    df: DataFrame, *, text: str = "text", row_id: str = "doc_id", sample_documents: int = SAMPLE_DOCUMENTS
) -> Model:
    """Trees for each kind, from a sample of ``df``."""
    spark = df.sparkSession
    ship(spark)
    rows = df.count()
    share = min(1.0, sample_documents / max(1, rows))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(row_id).cast("string"), F.lit(""))), F.lit(1 << 30))
    chosen = df.where((draw < int(share * (1 << 30))) & F.col(text).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(0):
                content = value.as_py()
                if _ANY.search(content):
                    found += examples(content)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([f[c] for f in found], pa.int32()) for c in range(3)],
                    pa.array([f[3] for f in found], pa.list_(pa.float64())),
                ],
                names=["kind", "label", "added", "x"],
            )

    got = chosen.select(text).mapInArrow(run, "kind int, label int, added int, x array<double>")
    # An order that depends on the rows alone, so that every run trains on the same.
    got = got.orderBy(F.xxhash64("x", "kind", "label", "added"), "kind", "label", "added").limit(SAMPLE_ROWS).collect()
    model: Model = {}
    for kind in range(len(KINDS)):
        own = [tuple(r) for r in got if r["kind"] == kind]
        if sum(not r[2] for r in own) < LEAST_SPANS:
            own += made_up(kind)
        label, added = np.array([r[1] for r in own], float), np.array([r[2] for r in own], bool)
        if trees := boost(np.array([r[3] for r in own]), label, added):
            model[kind] = trees
    return model


def find(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """``(base spans, added spans)`` of a text."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    taken = _Taken(base)
    judged = []
    # A span that touches a base span would add nothing; its parts beside it are proposed too.
    open_ = (p for p in proposals(text) if p[0] in model and not taken.touch(*p[1:]))
    for some in batched(open_, JUDGED):
        for kind in {p[0] for p in some}:
            own = [p for p in some if p[0] == kind]
            rows = np.array([features(kind, text[a:b], *_around(text, a, b)) for _, a, b in own])
            scores = model[kind].score(rows)
            for k in np.flatnonzero(scores >= model[kind].threshold):
                judged.append((-float(scores[k]), own[k][1] - own[k][2], own[k]))
    added: list[Span] = []
    used = _Taken([])
    # The best first; of equal scores the longer, then the first.
    for _, _, span in sorted(judged, key=lambda j: (j[0], j[1], j[2][1], j[2][0])):
        if not used.touch(*span[1:]):
            added.append(span)
            used.add(*span[1:])
    return base, added


class _Taken:
    """Places of a text that spans cover, as disjoint sorted ranges."""

    def __init__(self, spans: Sequence[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(s[1:] for s in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touch(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


def redact(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, done = [], 0
    merged: list[list[int]] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def detect(
    df: DataFrame, model: Model, *, text: str = "text", keep: Sequence[str] = ("doc_id",), redacted: str | None = None
) -> DataFrame:
    """Columns ``keep``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base``, ``spans``, ``n_added``.

    With ``redacted`` also a column of that name: the text without its spans, null where it is null.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
    fields += [T.StructField("n_added", T.LongType())]
    if redacted:
        fields.append(T.StructField("redacted", T.StringType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                counts = np.zeros((len(KINDS), part.num_rows), np.int64)
                base, every, more, clean = [], [], [], []
                for k, value in enumerate(part.column(0)):
                    content = value.as_py()
                    own, added = find(content or "", model)
                    for kind, _, _ in own:
                        counts[kind, k] += 1
                    base.append(joined(own))
                    every.append(joined([*own, *added]))
                    more.append(len(added))
                    if redacted:
                        clean.append(redact(content, [*own, *added]) if own or added else content)
                arrays = [*part.columns[1:], *[pa.array(c) for c in counts]]
                arrays += [pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(more, pa.int64())]
                if redacted:
                    arrays.append(pa.array(clean, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = df.select(F.col(text).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    out = rows.mapInArrow(run, T.StructType(fields))
    return out.toDF(*keep, *names[len(keep) : len(names) - bool(redacted)], *([redacted] if redacted else []))
