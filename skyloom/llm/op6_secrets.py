"""Secret scans: fixed base patterns, and a linear-chain conditional random field decoded by Viterbi.

Text is cut into tokens: runs of letters, digits and ``+/_-``, and single other characters. Each token is tagged as secret
begin, inside or outside from its own shape, the shapes of three tokens before and one after it (key words among them),
and features of the whole file. The field is trained here, on a bounded sample of documents in which the base patterns
and secrets made by rule are the labels. Base spans always stay; runs that the field tags are added where they overlap none.

Decoding is exact and costs the same whatever the weights and lengths of texts are: all tokens of a block are one chain, cut into
rows of ``ROW`` tokens. The best scores from each label before a row to each label at its end are found for all rows in
step, the rows are chained, and the path within each row is traced for all rows in step.

Null text counts as empty (no spans). Repeated rows and null ids stay; an empty table gives an empty one, and teaches the
field from rule-made lines alone; other columns are not read.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import blocks

#: Kinds of the base patterns, in the order of their spans, and the kind that the field adds.
BASE, FIELD = ("assign", "access", "hex"), "field"
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{16,}")
_KEYWORD = re.compile(r"(?ai)password|passwd|pwd|secret|token|api[_-]?key|credential|private[_-]?key|access[_-]?key")
#: All that the two patterns above can begin with, in lower case; a place that holds none of them can't match.
_ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEYWORD_NAMES = (*_ASSIGN_NAMES, "pwd", "api-key", "credential", *(f"{a}{b}key" for a in ("private", "access") for b in ("", "_", "-")))
#: Tokens on either side of a labelled one that are learned from, and tokens of a row that is decoded in step with others.
AROUND, ROW = 12, 64
#: Runs of tagged tokens with fewer characters are no secrets.
SHORTEST = 8
BLOCK = 1 << 19
OUT, BEGIN, INSIDE = 0, 1, 2
_MARKS = {'"': 0, "'": 0, "`": 0, ":": 1, "=": 2}
_PUNCT = 16 * 8 * 4 * 2
_EDGE = _PUNCT + 4
KINDS, FILES = _EDGE + 1, 16
#: Positions whose kinds a token sees, as distances from it.
SEEN = (0, -1, -2, -3, 1)


def _named(pattern: re.Pattern, names: tuple[str, ...], text: str) -> Iterator[re.Match]:
    """What ``pattern.finditer`` gives, tried only where ``text`` holds one of ``names``, in either case."""
    low = text.replace("\u0130", " ").lower()  # the one letter whose lower case is longer
    places = []
    for name in names:
        at = low.find(name)
        while at >= 0:
            places.append(at)
            at = low.find(name, at + 1)
    end = 0
    for at in sorted(places):
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind number and end of each base match, in order."""
    out = [(m.start(), 0, m.end()) for m in _named(_ASSIGN, _ASSIGN_NAMES, text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 space, 1 letter, 2 capital, 3 digit, 4 joining mark, 5 other."""
    out = np.full(0x110000, 5, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            out[c] = 0
        elif x.isalpha():
            out[c] = 2 if x.isupper() else 1
    out[[ord(c) for c in string.digits]] = 3
    out[[ord(c) for c in "+/_-"]] = 4
    return out


class Tokens:
    """Tokens of many texts in a row: places in the joined text, kinds, and each text's file features."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts) + "\n"
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = _classes()[points]
        word, other = (cls > 0) & (cls < 5), cls == 5
        edge = np.flatnonzero(np.concatenate(([word[0]], word[1:] != word[:-1])))
        singles = np.flatnonzero(other)
        starts, ends = edge[0::2], edge[1::2]
        order = np.argsort(np.concatenate((starts, singles)), kind="stable")
        self.starts = np.concatenate((starts, singles))[order]
        self.ends = np.concatenate((ends, singles + 1))[order]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.starts, self.offsets)  # first token of each text
        self.kinds = self._kinds(points, cls)
        self.files = self._files(cls, sizes)

    def _kinds(self, points: np.ndarray, cls: np.ndarray) -> np.ndarray:
        weight = np.array([0, 1, 1 << 21, 1 << 42, 0, 0], np.uint64)
        sums = np.concatenate(([0], np.cumsum(weight[cls], dtype=np.uint64))).astype(np.uint64)
        counts = sums[self.ends] - sums[self.starts]
        field = np.uint64((1 << 21) - 1)
        lower, upper, digit = counts & field, counts >> np.uint64(21) & field, counts >> np.uint64(42)
        length = (self.ends - self.starts).astype(np.uint64)
        marks = length > lower + upper + digit
        kind_of = np.array([0, 1, 1, 2, 3, 4], np.uint8)[cls]
        turns = np.concatenate(([0, 0], np.cumsum(kind_of[1:] != kind_of[:-1])))
        turn = np.digitize(turns[self.ends] - turns[np.minimum(self.starts + 1, self.ends)], (1, 3, 6))
        shape = (lower > 0) * 8 + (upper > 0) * 4 + (digit > 0) * 2 + marks * 1
        key = np.zeros(len(self.starts), np.int64)
        for m in _named(_KEYWORD, _KEYWORD_NAMES, self.text):
            key[np.searchsorted(self.starts, m.start(), "right") - 1] = 1
        kinds = ((shape * 8 + np.digitize(length, (2, 4, 8, 12, 16, 24, 40))) * 4 + turn) * 2 + key
        at = np.flatnonzero(cls[self.starts] == 5)
        mark = np.full(len(at), 3)
        for c, k in _MARKS.items():
            mark[points[self.starts[at]] == ord(c)] = k
        kinds[at] = _PUNCT + mark
        self.key = key
        return kinds

    def _files(self, cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        digits = np.concatenate(([0], np.cumsum(cls == 3)))[self.offsets]
        share = np.digitize(np.diff(digits) / np.maximum(sizes, 1), (0.002, 0.02, 0.2))
        keys = np.concatenate(([0], np.cumsum(self.key)))[self.first]
        equals = np.concatenate(([0], np.cumsum(self.kinds == _PUNCT + 2)))[self.first]
        return share * 4 + (np.diff(keys) > 0) * 2 + (np.diff(equals) > 0)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Kinds that each token sees, by SEEN, and its file's kind; nothing is seen across texts."""
        of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        lo, hi = self.first[:-1][of], self.first[1:][of]
        place = np.arange(len(self.kinds))
        seen = np.empty((len(SEEN), len(place)), np.int64)
        for k, d in enumerate(SEEN):
            at = place + d
            good = (at >= lo) & (at < hi)
            seen[k] = np.where(good, self.kinds[np.clip(at, 0, max(len(place) - 1, 0))], _EDGE) if len(place) else place
        return seen, self.files[of]


class Field:
    """Weights of the field: for what a token sees, for its file, and for neighbouring labels."""

    def __init__(self, seen: np.ndarray, file: np.ndarray, steps: np.ndarray):
        self.seen, self.file, self.steps = seen, file, steps

    def emissions(self, seen: np.ndarray, files: np.ndarray) -> np.ndarray:
        out = self.file[files].copy()
        for k in range(len(SEEN)):
            out += self.seen[k][seen[k]]
        return out

    def decode(self, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best labels of all sequences, which begin at ``starts``; each is entered as if from outside."""
        n = len(e)
        if not n:
            return np.zeros(0, np.int8)
        rows = -(-n // ROW)
        head = np.zeros(rows * ROW, bool)
        head[starts[starts < n]] = True
        head[n:] = True
        scores = np.zeros((rows * ROW, 3))
        scores[:n] = e
        head, scores = np.ascontiguousarray(head.reshape(rows, ROW).T), np.ascontiguousarray(scores.reshape(rows, ROW, 3).transpose(1, 2, 0))
        fresh = np.broadcast_to(self.steps[OUT], (3, 3))
        # by place: from label, to label, row
        step = [np.where(head[t], fresh[..., None], self.steps[..., None]) if head[t].any() else self.steps[..., None] for t in range(ROW)]
        whole = step[0] + scores[0]
        if whole.shape[2] != rows:
            whole = np.repeat(whole, rows, axis=2)
        for t in range(1, ROW):
            whole = np.stack([(whole + step[t][:, k]).max(axis=1) + scores[t, k] for k in range(3)], axis=1)
        best, came = (0.0, -np.inf, -np.inf), []
        for row in whole.transpose(2, 1, 0).tolist():
            paths = [[b + x for b, x in zip(best, to, strict=True)] for to in row]
            best = [max(p) for p in paths]
            came.append([p.index(b) for p, b in zip(paths, best, strict=True)])
        ends = np.zeros(rows + 1, np.int64)
        ends[rows] = best.index(max(best))
        for w in range(rows - 1, -1, -1):
            ends[w] = came[w][ends[w + 1]]
        entry = np.where(head[0], self.steps[OUT][:, None], self.steps[ends[:-1]].T)
        path, back = entry + scores[0], np.zeros((ROW, 3, rows), np.int8)
        for t in range(1, ROW):
            ways = path[:, None] + step[t]
            back[t] = ways.argmax(axis=0)
            path = ways.max(axis=0) + scores[t]
        labels, label, every = np.zeros((ROW, rows), np.int8), ends[1:], np.arange(rows)
        for t in range(ROW - 1, -1, -1):
            labels[t] = label
            if t:
                label = back[t, label, every]
        return labels.T.ravel()[:n]


def _spans(tokens: Tokens, labels: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of tagged tokens as places within each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(tokens.first) - 1)]
    at = np.flatnonzero(labels)
    text = np.searchsorted(tokens.first, at, "right") - 1
    for i, t in zip(at.tolist(), text.tolist(), strict=True):
        a, b, base = int(tokens.starts[i]), int(tokens.ends[i]), int(tokens.offsets[t])
        if labels[i] == INSIDE and out[t]:
            out[t][-1] = (out[t][-1][0], b - base)
        else:
            out[t].append((a - base, b - base))
    return out


def find(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text (kind, start, end), by start and kind."""
    tokens = Tokens(texts)
    labels = field.decode(field.emissions(*tokens.features()), tokens.first[:-1])
    out = []
    for text, added in zip(texts, _spans(tokens, labels), strict=True):
        base = base_spans(text)
        spans = base + [(a, 3, b) for a, b in added if b - a >= SHORTEST and not any(a < y and x < b for x, _, y in base)]
        out.append([((*BASE, FIELD)[k], a, b) for a, k, b in sorted(spans)])
    return out


# training


_LOWER, _EVERY = string.ascii_lowercase, string.ascii_letters + string.digits
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "access_key", "auth_token", "credential", "pwd", "private_key")


def made_secret(rng: random.Random) -> tuple[str, str, str]:
    """What comes before a secret made by rule, the secret, and what comes after it."""
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    secret = rng.choice((
        lambda: word("0123456789abcdef", rng.choice((32, 40, 64))), lambda: word(_EVERY, rng.randint(16, 48)), lambda: "AKIA" + word(string.ascii_uppercase + string.digits, 16),
        lambda: base64.b64encode(rng.randbytes(rng.randint(12, 40))).decode().rstrip("="), lambda: word(_LOWER, rng.randint(2, 4)) + "_" + word(_EVERY, rng.randint(24, 40)), lambda: word(_EVERY + "_-", rng.randint(14, 30)),
    ))()
    quote = rng.choice(("", '"', "'"))
    return rng.choice(_NAMES) + rng.choice((" = ", ": ", "=", " : ", " is ")) + quote, secret, quote


def made_plain(rng: random.Random) -> str:
    """A line that looks like a secret's and holds none: addresses, numbers, dates, paths, names, key words in prose."""
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    name, any_case = rng.choice(_NAMES), string.ascii_letters
    return rng.choice((
        lambda: f"{word(_LOWER, rng.randint(3, 9))}.{rng.randint(1, 99)}@{word(_LOWER, rng.randint(4, 9))}{rng.randint(1, 9)}.example.{word(_LOWER, 3)}", lambda: f"+{rng.randint(1, 99)} (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: f"version {rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 200)}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"{rng.choice(('host', 'ip', 'server', name))} {'.'.join(str(rng.randint(0, 255)) for _ in range(4))}:{rng.randint(80, 9999)}", lambda: f"https://{word(_LOWER, 6)}.example.com/{word(_LOWER, rng.randint(3, 20))}/{rng.randint(1, 99999)}.html",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}", lambda: f"{rng.randint(10**5, 10**12)}", lambda: f"the {name} of {word(_LOWER, 6)}",
        lambda: f"{name} {rng.choice(('is', 'for', 'and', 'was'))} {word(_LOWER, rng.randint(3, 18))}", lambda: word(any_case, rng.randint(12, 30)), lambda: word(string.ascii_uppercase, rng.randint(4, 20)),
        lambda: "-".join(word(_LOWER, rng.randint(3, 8)) for _ in range(3)), lambda: "_".join(word(_LOWER, rng.randint(3, 8)) for _ in range(3)), lambda: f"{name}: {word(_LOWER, rng.randint(2, 12))}", lambda: f"{word(_LOWER, 4)} = {rng.randint(0, 999)}",
        lambda: "/" + "/".join(word(_LOWER, rng.randint(3, 9)) for _ in range(4)), lambda: f"{word(_LOWER, 5)}{rng.randint(1, 999)}.{word(_LOWER, 3)}",
    ))()


def planted(rng: random.Random, text: str, secrets: int = 1, plain: int = 4) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with made lines put at its blanks, and the places of the made secrets."""
    words = text.split(" ")
    lines = [made_secret(rng) for _ in range(secrets)] + [("", "", made_plain(rng)) for _ in range(plain)]
    before: dict[int, list] = {}
    for line in lines:
        before.setdefault(rng.randint(0, len(words)), []).append(line)
    out, size, marked = [], 0, []
    for k in range(len(words) + 1):
        for lead, secret, rest in before.get(k, []):
            if secret:
                marked.append((size + len(lead), size + len(lead) + len(secret)))
            out.append(lead + secret + rest)
            size += len(out[-1]) + 1
        if k < len(words):
            out.append(words[k])
            size += len(words[k]) + 1
    return " ".join(out), marked


def _examples(texts: list[str]) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Training texts and the spans in them: base matches' values, and secrets made by rule."""
    rng, out, spans = random.Random(7), [], []
    for text in texts or ["the quick brown fox jumps over the lazy dog " * 3] * 200:
        own, marked = planted(rng, text)
        marked += [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(own) if m.end(2) - m.start(2) >= 12]
        marked += [(x, y) for x, k, y in base_spans(own) if k]
        out.append(own)
        spans.append(marked)
    return out, spans


def fit(texts: list[str], rounds: int = 80, rate: float = 1.0, decay: float = 1e-6) -> Field:
    """Trains the field by gradient ascent on the likelihood of windows around labelled and random tokens."""
    texts, spans = _examples(texts)
    tokens = Tokens(texts)
    seen, files = tokens.features()
    labels = np.zeros(len(tokens.starts), np.int64)
    for t, own in enumerate(spans):
        for a, b in sorted(set(own), reverse=True):
            lo, hi = np.searchsorted(tokens.ends, tokens.offsets[t] + a, "right"), np.searchsorted(tokens.starts, tokens.offsets[t] + b, "left")
            labels[lo:hi] = INSIDE
            labels[lo : lo + (hi > lo)] = BEGIN
    odd = np.flatnonzero((labels == BEGIN) | (np.random.default_rng(7).random(len(labels)) < min(1.0, 8 * len(texts) / max(1, len(labels)))))
    width = 2 * AROUND
    at = np.clip(odd[:, None] - AROUND + np.arange(width), 0, len(labels) - 1)
    at = at[(np.diff(at, axis=1) > 0).all(axis=1)]
    gold = labels[at]
    gold[gold[:, 0] == INSIDE, 0] = BEGIN
    s, f = seen[:, at], files[np.searchsorted(tokens.first, at, "right") - 1]
    field = Field(np.zeros((len(SEEN), KINDS, 3)), np.zeros((FILES, 3)), np.zeros((3, 3)))
    field.steps[OUT, INSIDE] = -np.inf
    grads = [np.zeros_like(x) for x in (field.seen, field.file, field.steps)]
    one, n = np.eye(3)[gold], len(at)
    pairs = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    for _ in range(rounds if n else 0):
        e = field.file[f] + sum(field.seen[k][s[k]] for k in range(len(SEEN)))
        x, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(field.steps)
        fore, aft, scale = np.empty_like(x), np.ones_like(x), np.empty((n, width, 1))
        for t in range(width):  # probabilities, scaled to sum to one at each place
            fore[:, t] = x[:, t] * (fore[:, t - 1] @ step if t else step[OUT])
            scale[:, t, 0] = fore[:, t].sum(axis=1)
            fore[:, t] /= scale[:, t]
        for t in range(width - 2, -1, -1):
            aft[:, t] = (x[:, t + 1] * aft[:, t + 1] / scale[:, t + 1]) @ step.T
        p = fore * aft
        joint = step * np.einsum("nti,ntj->ij", fore[:, :-1], (x * aft / scale)[:, 1:])
        miss = (one - p) / n
        new = [np.zeros_like(x) for x in (field.seen, field.file, field.steps)]
        for c in range(3):
            for k in range(len(SEEN)):
                new[0][k, :, c] = np.bincount(s[k].ravel(), weights=miss[..., c].ravel(), minlength=KINDS)
            new[1][:, c] = np.bincount(f.ravel(), weights=miss[..., c].ravel(), minlength=FILES)
        new[2] = (pairs - joint) / n
        for w, g, x in zip((field.seen, field.file, field.steps), grads, new, strict=True):
            good = np.isfinite(w)
            x = np.where(good, x - decay * np.where(good, w, 0), 0)
            g += x * x
            w += np.where(good, rate * x / (np.sqrt(g) + 1e-8), 0)
    return field


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = 600, longest: int = 20_000) -> Field:
    """Trains the field on a bounded sample: the whole texts of up to ``most_docs`` documents of at most ``longest`` characters, in
    hash order of the id; several texts of an id are several documents, and repeated rows are one."""
    rows = docs.where(F.length(text_col) <= longest).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    few = rows.select(F.col("id").alias("chosen"), F.col("digest").alias("mark")).orderBy(F.xxhash64("id"), "id", "digest").limit(most_docs).distinct()
    same = F.col("id").eqNullSafe(F.col("chosen")) & (F.col("digest") == F.col("mark"))
    found = rows.join(F.broadcast(few), same, "left_semi").dropDuplicates(["id", "digest"]).collect()
    return fit(sorted(r.text for r in found))


def spans(field: Field, text: Column) -> Column:
    """An array of (kind, start, end) for each text: base spans and what the field adds; places in code points."""
    weights = (field.seen.astype(np.float32), field.file.astype(np.float32), field.steps.astype(np.float32))

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Field(*weights)
        for batch in batches:
            texts, out = [t or "" for t in batch], []
            for lo, hi in blocks(texts, BLOCK):
                out += [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in find(own, texts[lo:hi])]
            yield pd.Series(out, dtype=object)

    return run(text)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``."""
    return docs.select(F.col(id_col).alias("doc_id"), spans(field, F.col(text_col)).alias("spans"))


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``; texts without spans stay as they are."""
    at = lambda a, b: F.substring(text, a + F.lit(1), b - a)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh = x.start >= s["at"]
        done = F.when(fresh, F.concat(s["done"], at(s["at"], x.start), F.lit(mark))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.greatest(s["at"], x.end).alias("at"))

    whole = F.aggregate(found, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + F.lit(1), F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
