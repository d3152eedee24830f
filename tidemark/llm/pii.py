"""Personal data: exact base patterns plus a semi-Markov conditional random field.

Four kinds of spans are reported. The base patterns are exact; the random field scores whole candidate
segments around digits, at-signs and spelled-out addresses, and a dynamic programme over segments of
bounded length chooses boundaries and kinds together. It only ever adds spans that touch no base span.

The field learns from base spans in a bounded sample of texts and from a few generated near misses (a
number that fails its check digit, a version number) and variants (a phone without a plus sign).

Null text counts as empty. Empty text has no spans. Rows are independent, so repeated rows and null ids
give the same spans each. Extra columns are left alone; output columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, bounded_sample, by_rows, table

#: Kinds in the order in which ties at one start are listed (fixed by contract).
KINDS = ("email", "ip", "card", "phone")
#: Texts sampled for training, and training windows taken per kind.
SAMPLE_TEXTS, WINDOWS_PER_KIND = 2000, 24
#: Bounds of an entity that the field may form.
MAX_TOKENS, MAX_CHARS = 12, 64
#: A window ends when no token with a trigger follows within this many tokens; longer ones are cut.
CONTEXT, MAX_WINDOW = 3, 64
EPOCHS, RATE, DECAY = 4, 0.3, 1e-3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]| dot ")
_TRIGGER_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*|(?<=\s)dot(?=\s)")
_SUB = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_AT_DOT = re.compile(r"[a-z0-9._-]+ (?:at|\(at\)|\[at\]) [a-z0-9-]+(?: dot [a-z]+)+\Z", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at-sign outwards, so that long words cost one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every base match that passes its check, sorted."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
            if all(len(x) < 4 and int(x) <= 255 for x in parts):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around each trigger with `CONTEXT` tokens on either side; overlapping ones are one window."""
    if not _TRIGGER.search(text):
        return
    begin = end = -1
    for m in _TRIGGER_TOKEN.finditer(text):
        left, right = _reach(text, m.start(), -1), _reach(text, m.end(), 1)
        if left <= end:
            end = max(end, right)
        else:
            if end >= 0:
                yield from _cut(text, begin, end)
            begin, end = left, right
    if end >= 0:
        yield from _cut(text, begin, end)


def _reach(text: str, at: int, step: int) -> int:
    """The place `CONTEXT` words before or after `at`, at most 64 characters away."""
    words, inside, stop = 0, False, max(0, at - 64) if step < 0 else min(len(text), at + 64)
    while at != stop:
        space = text[at - 1 if step < 0 else at].isspace()
        if inside and space:
            words += 1
            if words == CONTEXT:
                break
        inside = not space
        at += step
    return at


def _cut(text: str, begin: int, end: int) -> Iterator[list[tuple[int, int]]]:
    tokens = []
    for m in _SUB.finditer(text, begin, end):
        tokens.append(m.span())
        if len(tokens) == MAX_WINDOW:
            yield tokens
            tokens = tokens[-MAX_TOKENS:]  # an entity at the cut lies whole in one of the two windows
    if tokens:
        yield tokens


def segment_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span; empty if no kind can have this shape."""
    s = text[start:end]
    digits = [c for c in s if "0" <= c <= "9"]
    spelled = " dot " in s and bool(_AT_DOT.match(s))
    if not digits and "@" not in s and not spelled:
        return []
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        return []
    before, after = text[start - 1:start] or " ", text[end:end + 1] or " "
    letters = sum(c.isalpha() for c in s)
    numeric = letters == 0
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    found = ["bias", f"digits={min(len(digits), 20)}"] if numeric else ["lettered"]
    found.append("left_glued" if before.isalnum() or before in "@._%+-/=" else "left_free")
    found.append("right_glued" if after.isalnum() or after in "@_%/=" else "right_free")
    if before in " -.(" and _DIGIT.match(text[max(0, start - 2):start - 1] or " "):
        found.append("more_left")
    if after in " -.)" and _DIGIT.match(text[end + 1:end + 2] or " "):
        found.append("more_right")
    if s.count("@") == 1 and " " not in s:
        found.append("address" if _DOMAIN.fullmatch(s.partition("@")[2]) and _LOCAL.match(s.partition("@")[0]) else "odd_at")
    if spelled:
        found.append("spelled_address")
    if numeric:
        joined = "".join(digits)
        found.append("groups=" + "-".join(map(str, groups[:6])))
        found.append("seps=" + "".join(sorted(set(s) - set("0123456789"))))
        if 12 <= len(digits) <= 19 and set(s) <= set("0123456789 -"):
            found.append("luhn" if luhn(joined) else "no_luhn")
        if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s):
            found.append("octets" if all(int(x) <= 255 for x in s.split(".")) else "no_octets")
        if len(digits) in range(9, 16):
            found.append("phone_length" + ("_plus" if s[0] == "+" else "_grouped" if len(groups) > 2 else ""))
    cue = re.search(r"([^\W\d_]+)[\s:=\"]*\Z", text[max(0, start - 24):start])
    if cue and len(cue[1]) < 12:
        found.append("cue=" + cue[1].lower())
    return found


def _segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """(first token, token after the last, features) of every candidate segment of bounded length."""
    out = []
    for i, (start, _) in enumerate(tokens):
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            end = tokens[j][1]
            if end - start > MAX_CHARS:
                break
            if found := segment_features(text, start, end):
                out.append((i, j + 1, found))
    return out


class Field:
    """Weights by (feature, kind) and by (previous label, label); label 0 is a token outside any entity."""

    def __init__(self) -> None:
        self.weights: dict[str, list[float]] = {}
        self.follow = [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    def scores(self, found: list[str]) -> list[float]:
        rows = [self.weights[f] for f in found if f in self.weights]
        return [sum(r[k] for r in rows) for k in range(len(KINDS))]

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (start, kind, end); ties go to the one with fewer entities."""
        ending: dict[int, list] = {}
        for i, j, found in _segments(text, tokens):
            ending.setdefault(j, []).append((i, self.scores(found)))
        labels = range(len(KINDS) + 1)
        best = [[0.0] + [-math.inf] * len(KINDS)]
        back: list[list] = [[None] * (len(KINDS) + 1)]
        for j in range(1, len(tokens) + 1):
            row, links = [-math.inf] * (len(KINDS) + 1), [None] * (len(KINDS) + 1)
            for p in labels:
                if (value := best[j - 1][p] + self.follow[p][0]) > row[0]:
                    row[0], links[0] = value, (j - 1, p)
            for i, scores in ending.get(j, ()):
                for p in labels:
                    if best[i][p] > -math.inf:
                        for k, score in enumerate(scores, 1):
                            if (value := best[i][p] + self.follow[p][k] + score) > row[k]:
                                row[k], links[k] = value, (i, p)
            best.append(row)
            back.append(links)
        label, j, out = max(labels, key=lambda k: (best[-1][k], -k)), len(tokens), []
        while j:
            i, previous = back[j][label]
            if label:
                out.append((tokens[i][0], label - 1, tokens[j - 1][1]))
            label, j = previous, i
        return out[::-1]

    def learn(self, text: str, tokens: list, gold: list[tuple[int, int, int]], segments: list, rate: float) -> None:
        """One gradient step on the log-likelihood of the gold segmentation (forward and backward sums)."""
        n, size = len(tokens), len(KINDS) + 1
        follow = np.array(self.follow)
        arcs = [(i, i + 1, None, [0.0]) for i in range(n)]
        arcs += [(i, j, found, self.scores(found)) for i, j, found in segments]
        arcs.sort(key=lambda a: (a[1], a[0]))
        forward, backward = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf)
        forward[0, 0], backward[n] = 0.0, 0.0

        def labels(arc):
            return [0] if arc[2] is None else range(1, size)

        with np.errstate(divide="ignore", invalid="ignore"):
            for arc in arcs:
                come = np.logaddexp.reduce(forward[arc[0]][:, None] + follow, axis=0)
                for place, k in enumerate(labels(arc)):
                    forward[arc[1], k] = np.logaddexp(forward[arc[1], k], come[k] + arc[3][place])
            for arc in sorted(arcs, key=lambda a: (-a[0], -a[1])):
                for place, k in enumerate(labels(arc)):
                    value = follow[:, k] + arc[3][place] + backward[arc[1], k]
                    backward[arc[0]] = np.logaddexp(backward[arc[0]], value)
            total = np.logaddexp.reduce(forward[n])
            step = np.zeros((size, size))
            starts, stops = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            wanted = {(starts[a], stops[b]): k + 1 for a, k, b in gold if a in starts and b in stops}
            inside = {t for (i, j) in wanted for t in range(i, j)}
            previous_at = {0: 0}
            for i, j in sorted([*wanted, *((t, t + 1) for t in range(n) if t not in inside)]):
                k = wanted.get((i, j), 0)
                step[previous_at.get(i, 0), k] += 1
                previous_at[j] = k
            for arc in arcs:
                for place, k in enumerate(labels(arc)):
                    each = np.exp(forward[arc[0]] + follow[:, k] + arc[3][place] + backward[arc[1], k] - total)
                    step[:, k] -= each
                    if k:
                        change = (wanted.get((arc[0], arc[1])) == k) - each.sum()
                        if abs(change) > 1e-4:
                            for f in arc[2]:
                                row = self.weights.setdefault(f, [0.0] * len(KINDS))
                                row[k - 1] += rate * (change - DECAY * row[k - 1])
        self.follow = (follow + rate * step).tolist()


def _variants(count: int = 16) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated training windows: near misses without an entity, and variants that base patterns miss."""
    pick, out = random.Random(7), []

    def add(left: str, body: str, right: str, kind: int | None) -> None:
        out.append((left + body + right, [] if kind is None else [(len(left), kind, len(left) + len(body))]))

    def digits(n: int) -> str:
        return "".join(pick.choice("0123456789") for _ in range(n))

    for _ in range(count):
        word = "".join(pick.choice("abcdeghilmnorstu") for _ in range(pick.randint(3, 8)))
        left, right = f"{word} und ", f" {word[::-1]} re"
        number = "4" + digits(15)
        add(left, number, right, 2 if luhn(number) else None)
        add(left, f"{digits(1)}.{digits(1)}.{digits(2)}", right, None)
        add(left, f"{pick.randint(300, 900)}.{pick.randint(1, 255)}.{pick.randint(1, 255)}.7", right, None)
        add(left, str(pick.randint(1, 99999)), right, None)
        add(f"{word} token = \"", hashlib.md5(word.encode()).hexdigest(), f"\" {word}", None)
        add(f"{word} call ", f"({pick.randint(200, 989)}) {digits(3)}-{digits(4)}", right, 3)
        add(f"{word} phone: ", f"{pick.randint(200, 989)}-{digits(3)}-{digits(4)}", right, 3)
        add(left, f"{word} at {word[::-1]} dot com", right, 0)
        add(left, f"{word}@{word[::-1]}", right, None)
        add(left, digits(pick.choice((9, 10, 11, 13, 20))), right, None)
        add(left, f"{digits(3)} {digits(3)} {digits(4)}", right, None)
        add(left, f"20{digits(2)}-0{pick.randint(1, 9)}-1{digits(1)} 1{digits(1)}:{digits(2)}:{digits(2)}", right, None)
    return out


def _training_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of each text with their base spans, relative to the window's piece of text."""
    for frame in by_rows(frames):
        out = []
        for text in frame["text"]:
            spans = base_spans(text or "")
            for tokens in windows(text or ""):
                left, right = max(0, tokens[0][0] - 24), tokens[-1][1] + 2
                gold = [(a - left, k, b - left) for a, k, b in spans if tokens[0][0] <= a and b <= tokens[-1][1]]
                piece = text[left:right]
                out.append((gold[0][1] if gold else -1, piece, tokens[0][0] - left, tokens[-1][1] - left,
                            ",".join(f"{a}:{k}:{b}" for a, k, b in gold)))
        yield pd.DataFrame(out, columns=["kind", "piece", "begin", "stop", "gold"])


def train(docs: DataFrame) -> Field:
    """The field fitted to at most `WINDOWS_PER_KIND` windows per kind and the generated variants."""
    rows = bounded_sample(docs.select("text").where(F.col("text").isNotNull()), SAMPLE_TEXTS).mapInPandas(
        _training_rows, "kind int, piece string, begin int, stop int, gold string")
    order = F.row_number().over(_by_hash())
    picked = rows.withColumn("nth", order).where(F.col("nth") <= WINDOWS_PER_KIND).collect()
    cases = []
    for row in picked:
        gold = [tuple(map(int, x.split(":"))) for x in row.gold.split(",") if x]
        tokens = [m.span() for m in _SUB.finditer(row.piece, row.begin, row.stop)]
        cases.append((row.piece, tokens, gold))
    for text, gold in _variants():
        cases.append((text, [m.span() for m in _SUB.finditer(text)], gold))
    cases.sort(key=lambda c: hashlib.md5(c[0].encode("utf-8", "replace")).digest())
    prepared = [(text, tokens, gold, _segments(text, tokens)) for text, tokens, gold in cases if len(tokens) <= MAX_WINDOW]
    field = Field()
    for epoch in range(EPOCHS):
        for text, tokens, gold, segments in prepared:
            if segments:
                field.learn(text, tokens, gold, segments, RATE / (1 + epoch))
    return field


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("kind").orderBy(F.xxhash64("piece"), "piece", "begin", "gold")


def find_spans(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that the field adds) of a whole text, as (start, kind, end)."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added: list[tuple[int, int, int]] = []
    for tokens in windows(text):
        for a, kind, b in field.decode(text, tokens):
            if all(b <= x or y <= a for x, _, y in base) and all(b <= x or y <= a for x, _, y in added):
                added.append((a, kind, b))
    return base, sorted(added)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with array columns `base` and `added` of (kind, start, end); code points, end exclusive."""
    def spans_of(texts: pd.Series) -> pd.DataFrame:
        found = [find_spans(t, field) for t in texts]
        listed = [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in part] for part in pair] for pair in found]
        return pd.DataFrame({"base": [x[0] for x in listed], "added": [x[1] for x in listed]})

    span = "array<struct<kind:string,start:int,`end`:int>>"
    udf = F.pandas_udf(spans_of, f"base {span}, added {span}")
    return bound_batches(docs).withColumn("_spans", udf("text")).withColumns(
        {"base": F.col("_spans.base"), "added": F.col("_spans.added")}).drop("_spans")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; all other columns stay."""
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            base, added = find_spans(text, field)
            done, pieces = 0, []
            for a, kind, b in sorted(base + added):
                if b <= done:
                    continue
                pieces += [text[done:max(a, done)], f"[{KINDS[kind].upper()}]"]
                done = b
            out.append("".join([*pieces, text[done:]]) if pieces else text)
        return pd.Series(out, dtype=object)

    changed = bound_batches(docs).withColumn("text", F.pandas_udf(masked, "string")("text"))
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def _listing(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole document: counts of base spans by kind, their digest, and the list of all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, train(docs))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = {f"n_{k}": F.size(F.filter("base", _is_kind(k))).cast("long") for k in KINDS}
    return found.withColumn("all", ordered).select(
        "doc_id", *[c.alias(n) for n, c in counts.items()],
        F.sha2(_listing("base"), 256).alias("base_sha256"), _listing("all").alias("spans"),
        F.size("added").cast("long").alias("n_added"))
