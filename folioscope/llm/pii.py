"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained from a small labelled table and decoded by Viterbi over numpy batches of lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pii_labels import GIVEN_NAMES, labelled

KINDS = ["email", "ip", "card", "phone", "name", "id"]
#: Labels of the field: none, or the kind of personal data that a word belongs to.
LABELS = ["O", "email", "phone", "name", "id"]
#: Added to the score of O at each word when decoding, so that doubtful words stay unmarked.
CAUTION = 1.5
MAX_LABELLED_ROWS = 20_000
EPOCHS, STEP, DECAY = 80, 0.25, 2e-5
#: Words whose scores a worker remembers; characters of text, and words times lines, that it decodes at a time.
REMEMBERED, CHARS_AT_ONCE, CELLS_AT_ONCE = 200_000, 1 << 20, 1 << 18

# ---------------------------------------------------------------- fixed patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_ANY = re.compile(r"[0-9@]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in linear time: each `@` is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        # What precedes this sign can't be part of a later match, which has no `@` before its own.
        done = end
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order of start and kind."""
    if not _ANY.search(text):
        return []
    out = [(s, e, "email") for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- the field

_RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x"), (re.compile(r"\d+"), lambda m: "d" * min(4, len(m[0])))]
TRIM = ".,;:!?()[]{}\"'«»…*#%&$|"


def shape(word: str) -> str:
    """Word shape: letter runs as X, Xx or x, digit runs as up to four d, other characters as themselves, up to 24 in all."""
    word = word[:64]
    for pattern, to in _RUNS[::-1]:
        word = pattern.sub(to, word) if pattern is _RUNS[0][0] else pattern.sub(lambda m: "\0" * min(4, len(m[0])), word)
    return word.replace("\0", "d")[:24]


_REPEAT = re.compile(r"(.)\1+")
_SPELLED = re.compile(r"[(\[{]\s*(?:at|dot)\s*[)\]}]")


def word_features(word: str, cues: frozenset[str]) -> list[str]:
    """What the field sees of a word: separate features, so that an unseen combination still has the weights of its parts."""
    bare = word.strip(TRIM)[:64]
    low, whole = bare.lower(), shape(bare)
    digits = sum(c.isdigit() for c in bare)
    out = ["any", f"shape={whole}", f"short={_REPEAT.sub(lambda m: m[1], whole)}", f"first={word[:1] if word[:1] in TRIM else ''}", f"digits={min(digits, 12)}"]
    if low in cues:
        out.append(f"cue={low}")
    elif low.isalpha():
        out.append("uncued")
    if word[-1:] in ".,;:!?)]":
        out.append(f"mark={word[-1:]}")
    if bare[:1].isupper() and len(bare) > 1 and bare[1:].islower():
        out.append("capital")
        if low in GIVEN_NAMES:
            out.append("given")
    if bare.isalpha():
        out.append(f"suffix={low[-2:]}" if len(low) > 4 else f"letters={len(low)}")
    if digits and any(c.isalpha() for c in bare):
        out.append("letters and digits")
    if digits and any(c in "-./" for c in bare):
        out.append("digits and marks")
    if digits == 9 and whole == "ddd-dd-dddd":
        out.append("three two four")
    if _SPELLED.search(word.lower()):
        out.append("spelled")
    return out


class Scores(dict):
    """Word to its row in `table`: the label scores that it gives to itself, the word after and the word before it.

    Row 0 stands for no word (the ends of a line).
    """

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.table, self.used = np.zeros((1024, 3, len(LABELS)), np.float32), 0
        self._add([model["number"]["no word"]])

    def _add(self, numbers: list[int]) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.used] = self.model["weights"][:, numbers].sum(axis=1)
        self.used += 1
        return self.used - 1

    def __missing__(self, word: str) -> int:
        number = self.model["number"]
        self[word] = row = self._add([number[f] for f in word_features(word, self.model["cues"]) if f in number])
        return row

    def trim(self) -> None:
        """Forgets all words once there are more than REMEMBERED; rows given out before are void then."""
        if self.used > REMEMBERED:
            self.clear()
            self.used = 1


def train(labelled_rows: list[tuple[list[str], list[str]]]) -> dict:
    """Fits the field by gradient ascent on the conditional likelihood, over padded numpy batches.

    `labelled_rows`: (words, labels) of each sentence. A label's score at a word is the sum of weights of the features of the
    word itself, of the word before and of the word after. Cues are words that three sentences have outside of labels.
    """
    sentences: Counter[str] = Counter()
    for words, tags in labelled_rows:
        sentences.update({w.strip(TRIM).lower() for w, t in zip(words, tags, strict=True) if t == "O"})
    cues = frozenset(w for w, n in sentences.items() if n >= 3 and w.isalpha())
    number: dict[str, int] = {"no word": 0}
    known = {w: i + 1 for i, w in enumerate(sorted({w for words, _ in labelled_rows for w in words}))}
    of_word = [[0]] + [[number.setdefault(f, len(number)) for f in word_features(w, cues)] for w in known]
    x = np.zeros((len(of_word), len(number)), np.float32)
    for i, features in enumerate(of_word):
        x[i, features] = 1
    n, t, s = len(labelled_rows), max(len(w) for w, _ in labelled_rows), len(LABELS)
    own = np.zeros((n, t + 2), np.int64)
    gold = np.zeros((n, t), np.int64)
    for i, (words, tags) in enumerate(labelled_rows):
        own[i, 1 : len(words) + 1] = [known[w] for w in words]
        gold[i, : len(words)] = [LABELS.index(y) for y in tags]
    length = np.array([len(w) for w, _ in labelled_rows])
    inside = np.arange(t)[None] < length[:, None]
    views = [own[:, 1:-1], own[:, :-2], own[:, 2:]]
    w = [np.zeros((len(number), s), np.float32) for _ in views]
    tr = np.zeros((s + 1, s))  # last row: from the start
    moments = [np.zeros_like(y) for y in [*w, tr]]
    hot = np.eye(s)[gold] * inside[..., None]
    pairs = inside[:, 1:]
    for _ in range(EPOCHS):
        e = sum((x @ y)[v] for y, v in zip(w, views, strict=True)).astype(np.float64)
        alpha, beta = np.zeros((n, t, s)), np.zeros((n, t, s))
        alpha[:, 0] = e[:, 0] + tr[s]
        for i in range(1, t):
            step = _lse(alpha[:, i - 1, :, None] + tr[None, :s], 1) + e[:, i]
            alpha[:, i] = np.where(inside[:, i, None], step, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = _lse(tr[None, :s] + (e[:, i + 1] + beta[:, i + 1])[:, None], 2)
            beta[:, i] = np.where(inside[:, i + 1, None], step, 0)
        z = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + tr[None, None, :s] + (e[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None]) * pairs[..., None, None]
        gap = hot - node
        grads = []
        for y, v in zip(w, views, strict=True):
            by_word = np.zeros((len(of_word), s), np.float32)
            np.add.at(by_word, v[inside], gap[inside].astype(np.float32))
            grads.append(x.T @ by_word - DECAY * n * y)
        g = -DECAY * n * tr
        g[:s] += np.einsum("nta,ntb->ab", hot[:, :-1] * pairs[..., None], hot[:, 1:]) - edge.sum((0, 1))
        g[s] += gap[:, 0].sum(0)
        grads.append(g)
        for y, g, m in zip([*w, tr], grads, moments, strict=True):
            m += g * g
            y += STEP * g / np.sqrt(m + 1e-8)
    # Order of the views: own, what a word gives to the one after it, what it gives to the one before.
    return {"cues": cues, "number": number, "weights": np.stack(w).astype(np.float32), "moves": tr.astype(np.float32)}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def viterbi(model: dict, table: np.ndarray, lines: list[np.ndarray]) -> list[np.ndarray]:
    """Best labels of each line of rows of `table`; lines of like length go together, within CELLS_AT_ONCE."""
    s, out = len(LABELS), [None] * len(lines)
    moves, order, at = model["moves"], sorted(range(len(lines)), key=lambda i: len(lines[i])), 0
    while at < len(order):
        t = len(lines[order[at]])
        group = []
        while at < len(order) and (not group or (len(group) + 1) * len(lines[order[at]]) <= CELLS_AT_ONCE) and len(lines[order[at]]) <= t + t // 4 + 4:
            group.append(order[at])
            at += 1
        length = np.array([len(lines[i]) for i in group])
        t, n = int(length.max()), len(group)
        # Padded with the mark of no word on both sides, as in training.
        own = np.zeros((n, t + 2), np.int64)
        for r, i in enumerate(group):
            own[r, 1 : length[r] + 1] = lines[i]
        e = table[own[:, 1:-1].T, 0] + table[own[:, :-2].T, 1] + table[own[:, 2:].T, 2]
        e[..., 0] += CAUTION
        e = np.ascontiguousarray(e.transpose(0, 2, 1))  # position, label, line
        back = np.empty((t, s, n), np.int8)
        best = e[0] + moves[s][:, None]
        still = np.repeat(np.arange(s, dtype=np.int8)[:, None], n, axis=1)
        for i in range(1, t):
            top = best[0] + moves[0][:, None]
            b = np.zeros((s, n), np.int8)
            for k in range(1, s):
                other = best[k] + moves[k][:, None]
                better = other > top
                b[better] = k
                np.maximum(top, other, out=top)
            top += e[i]
            if i >= length[0]:  # the shortest line comes first
                run = i < length
                top, b = np.where(run, top, best), np.where(run, b, still)
            best, back[i] = top, b
        now = best.argmax(axis=0)
        path = np.empty((n, t), np.int8)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            path[:, i] = now
            now = back[i][now, rows]
        for r, i in enumerate(group):
            out[i] = path[r, : length[r]]
    return out


_WORD = re.compile(r"\S+")


def field_spans(scores: Scores, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans that the field finds in each text, line by line; marks around a span are trimmed."""
    scores.trim()
    lines, where = [], []
    for d, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if words := line.split():
                lines.append(np.fromiter(map(scores.__getitem__, words), np.int64, len(words)))
                where.append((d, at, line))
            at += len(line) + 1
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (d, at, line), path in zip(where, viterbi(scores.model, scores.table, lines), strict=True):
        if not path.any():
            continue
        spans, open_kind = [], None
        for m, label in zip(_WORD.finditer(line), path.tolist(), strict=True):
            kind = LABELS[label] if label else None
            if kind and kind == open_kind:
                spans[-1][1] = m.end()
            elif kind:
                spans.append([m.start(), m.end(), kind])
            open_kind = kind
        for start, end, kind in spans:
            while start < end and line[start] in TRIM and not (kind == "phone" and line[start] == "("):
                start += 1
            while start < end and line[end - 1] in TRIM:
                end -= 1
            if start < end:
                out[d].append((at + start, at + end, kind))
    return out


def labelled_table(spark) -> DataFrame:
    """The built-in labelled table: sentence, position, word, label."""
    rows = [(i, j, w, t) for i, (words, tags) in enumerate(labelled()) for j, (w, t) in enumerate(zip(words, tags, strict=True))]
    return spark.createDataFrame(rows, "sentence int, position int, word string, label string")


def fit(table: DataFrame) -> dict:
    """Trains the field from a labelled table of at most MAX_LABELLED_ROWS rows (more are refused)."""
    rows = table.dropna().limit(MAX_LABELLED_ROWS + 1).collect()
    if len(rows) > MAX_LABELLED_ROWS:
        raise ValueError(f"more than {MAX_LABELLED_ROWS} labelled rows")
    sentences: dict = {}
    for r in sorted(rows, key=lambda r: (r["sentence"], r["position"])):
        words, tags = sentences.setdefault(r["sentence"], ([], []))
        words.append(r["word"])
        tags.append(r["label"])
    return train(list(sentences.values()))


def _by_size(column: pa.Array) -> Iterator[list[str]]:
    """The texts in groups of about CHARS_AT_ONCE characters; null as empty."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1]) + 1
        if size >= CHARS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))


def find_pii(df: DataFrame, model: dict, text: str = "text", spans: str = "pii") -> DataFrame:
    """Adds `spans`: an array of (start, end, kind, base) in code points, end exclusive, by start and kind.

    All spans of the fixed patterns (base), and the field's spans that overlap none of these. Null text counts as empty.
    Whole texts of any length; other columns stay, a namesake is replaced. No shuffle; the model's size is fixed.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != spans]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(spans, SPANS)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(held.value)
        for batch in batches:
            made = []
            for texts in _by_size(batch.column(batch.schema.get_field_index(text))):
                for t, more in zip(texts, field_spans(scores, texts), strict=True):
                    base = base_spans(t)
                    free = [s for s in more if all(s[1] <= b[0] or b[1] <= s[0] for b in base)]
                    found = sorted([(*s, True) for s in base] + [(*s, False) for s in free], key=lambda s: (s[0], KINDS.index(s[2])))
                    made.append([dict(zip(("start", "end", "kind", "base"), s, strict=True)) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(made, arrow)], names=[*kept, spans])

    return df.mapInArrow(run, schema)
