"""Personal data: four patterns, and a linear-chain CRF over word-shape features.

The patterns find e-mail addresses, IPv4 addresses, card numbers and international
phone numbers.  The CRF labels the words of each line (O, B, I) from their shapes
and those of their neighbours and adds what the patterns miss: national phone
numbers, identity numbers, account numbers, and names behind a cue.  It is trained
on the driver from a small labelled table (``LABELLED`` lines and ``training_table``) by
gradient ascent on the conditional likelihood, and decoded by Viterbi over all lines
of a slice at once.  A line is decoded only if some word could leave label O at all;
for every other line the path of O alone is provably best.

Edge cases: a null or empty text has no spans; an empty table gives an empty result,
repeated rows each have theirs, columns other than doc_id and text are ignored; texts are
scanned whole, line by line; positions are code points of the
whole text; CRF spans that touch a pattern's span are dropped.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import Span, digest, joined, outside, redact
from .textkit import map_slices

KINDS = ("email", "ip", "card", "phone", "crf")
#: An address around its sign, each side scanned once: the name before it from right to left, the host behind it.
_NAME_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost and non-overlapping, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at - _NAME_END.match(text[done:at][::-1]).end()
        host = _HOST.match(text, at + 1) if start < at else None
        # Names hold no sign, so what stands before this one is not looked at again.
        done = host.end() if host else at + 1
        if host:
            out.append(("email", start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and non-overlapping per kind; failing matches go.  Time is linear in the text."""
    spans: list[Span] = []
    if "@" in text:
        spans += _emails(text)
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


# ---------------------------------------------------------------- features

#: Fixed cue words of the four languages, by what they announce.
CUES = {
    "name": {"name", "mr", "mrs", "ms", "dr", "nombre", "señor", "señora", "nom", "monsieur", "madame", "herr", "frau"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax", "teléfono", "téléphone", "telefon", "handy"},
    "id": {"ssn", "passport", "dni", "nif", "iban", "account", "cuenta", "compte", "konto", "ausweis", "pasaporte"},
}
_CUE = {w: k for k, words in CUES.items() for w in words}
LABELS = ("O", "B", "I")


def shape(word: str) -> str:
    """X for capitals, x for other letters, d for digits, the rest as it is; runs of over two shortened."""
    out: list[str] = []
    for c in word:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def word_features(word: str) -> tuple[str, ...]:
    """Features of a word, without its neighbours."""
    if word.isalpha() and word.islower():  # most words of prose
        cue = _CUE.get(word)
        return ("cue=" + cue, "prose") if cue else ("prose",)
    bare = word.rstrip(".,;:!?")
    digits = sum(c.isdigit() for c in bare)
    cue = _CUE.get(bare.lower().strip("'\"()"))
    out = ["shape=" + shape(bare), "end=" + word[len(bare) :][:1], f"digits={min(digits, 12)}", f"len={min(len(bare), 30) // 3}"]
    if cue:
        out.append("cue=" + cue + (":" if word.endswith(":") else ""))
    if bare[:1].isupper() and bare[1:].islower():
        out.append("title")
    return tuple(out)


def training_table(size: int = 300, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: (words, labels) of lines written from templates."""
    r = random.Random(seed)
    syllables = ["an", "ber", "co", "de", "er", "fi", "ga", "ho", "in", "ka", "le", "mo", "na", "or", "pe", "ri", "st", "th", "un", "za"]
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    title = lambda: word().capitalize()
    prose = lambda: title() + r.choice(["", ".", ","]) if r.random() < 0.15 else word() + r.choice(["", "", "", ",", "."])
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    private = [
        lambda: [f"({num(3)})", f"{num(3)}-{num(4)}"],
        lambda: [f"{num(3)}-{num(3)}-{num(4)}"],
        lambda: [f"{num(3)}.{num(3)}.{num(4)}"],
        lambda: [f"{num(3)}-{num(2)}-{num(4)}"],
        lambda: [upper(2) + num(2), *(num(4) for _ in range(4)), num(2)],
        lambda: [upper(2) + num(20)],
    ]
    cued = {"name": lambda: [title(), title()], "phone": lambda: [f"{num(4)}-{num(4)}"], "id": lambda: [num(8) + upper(1)]}
    public = [
        lambda: [num(r.randint(1, 6))], lambda: [f"{num(2)}.{num(2)}"], lambda: [f"20{num(2)}-{num(2)}-{num(2)}"],
        lambda: [f"password={hexa(18)}"], lambda: ["token", "=", f'"{hexa(40)}"'], lambda: ["AKIA" + upper(8) + num(2) + upper(6)],
        lambda: [f"{num(1)}.{num(1)}.{num(1)}"], lambda: ["$" + num(4)], lambda: [num(2) + "%"], lambda: [hexa(12)], lambda: [title(), title()],
        lambda: ["|", word(), "|"], lambda: [word() + "###"], lambda: [f"#{num(3)}"], lambda: [num(16)], lambda: [f"{word()}@{word()}.com"],
        lambda: [f"{num(2)}.{num(3)}.{num(2)}.{num(3)}"], lambda: ["+" + num(1), f"({num(3)})", f"{num(3)}-{num(4)}"],
        lambda: [f"https://{word()}.example/{num(4)}"], lambda: [r.choice(sorted(_CUE)), word()], lambda: [f"{num(2)}:{num(2)}"], lambda: [upper(3)],
    ]
    rows = []
    for k in range(size):
        words = [prose() for _ in range(r.randint(2, 9))]
        labels = ["O"] * len(words)
        if k % 2:
            if r.random() < 0.4:
                kind = r.choice(sorted(cued))
                cue, found = r.choice(sorted(CUES[kind])), cued[kind]()
                words.append((cue.capitalize() if r.random() < 0.5 else cue) + ":")
                labels.append("O")
            else:
                found = r.choice(private)()
            found[-1] += r.choice(["", "", ".", ","])
            words += found
            labels += ["B"] + ["I"] * (len(found) - 1)
        else:
            found = r.choice(public)()
            words += found
            labels += ["O"] * len(found)
        tail = [prose() for _ in range(r.randint(0, 6))]
        rows.append((words + tail, labels + ["O"] * len(tail)))
    return rows


#: A small labelled table of written lines: personal data stands between [ and ].
LABELLED = """
You can reach our night desk at [020 7946 0958] until six.
My office line is [(415) 555-0132], ask for the second floor.
Please text [415-555-0178] before you come.
tel: [555-0147]
mobile: [0171 555 0199] or leave a note
Teléfono: [912 34 56 78], de lunes a viernes.
Llame al [600 123 456] para pedir hora.
Téléphone : [01 23 45 67 89] le matin.
Appelez le [06 12 34 56 78] avant midi.
Telefon: [030 1234567] (Zentrale)
Rufen Sie [0301 234567] an, wenn etwas fehlt.
Her social security number is [078-05-1120] on the form.
SSN: [219-09-9999]
passport: [X1234567A] issued in May
DNI: [12345678Z]
El documento [87654321X] figura en la solicitud.
IBAN: [GB29 NWBK 6016 1331 9268 19]
Transfer it to [DE89 3704 0044 0532 0130 00] by Friday.
Bitte auf [DE75512108001245126199] zahlen.
Compte [FR14 2004 1010 0505 0001 3M02 606] ouvert hier.
Konto: [AT61 1904 3002 3457 3201]
Name: [Clara Weiss], room 12
name: [John Carter] signed twice
Nombre: [Lucía Pérez]
Nom : [Paul Durand] et sa soeur
Frau [Helga Brandt] kommt um drei.
Mr. [Adam Stone] was late again.
account: [00123456789]
The meeting is on 2021-05-14 at 10:30 in room 4012.
Order 88213 shipped with 3 boxes of 12 each.
Version 2.10.3 fixed 14 bugs and 2 crashes.
It cost $1,250 or 1.100 euros in 1998.
The Grand Hotel opened in March 1901 near Lake Como.
See pages 112-118 of volume 4, table 3.2.
In 2019 the team scored 98-87 in game 7.
call the clerk when the name of the street is known
The account of the journey was long and the phone was dead.
Part no. 4471-B fits models 200 and 210.
Temperatures of -3.5 to 12.25 degrees were measured 365 times.
El capítulo 12 trata de 1492 y 1513.
Le numéro 7 de la rue est fermé depuis 1987.
Die Auflage von 1854 hat 320 Seiten und 12 Karten.
ISBN 978-3-16-148410-0 was printed in 2500 copies.
The ratio was 3:2 and later 16:9 at 1080p.
commit 9f86d081 changed 42 files on 2020-01-02.
"""


def labelled_lines(text: str = LABELLED) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of lines with marked spans."""
    rows = []
    for line in text.strip().split("\n"):
        words, labels, inside = [], [], False
        for word in line.split():
            starts = word.startswith("[")
            words.append(re.sub(r"[\[\]]", "", word))
            labels.append("B" if starts else "I" if inside else "O")
            inside = (inside or starts) and "]" not in word
        rows.append((words, labels))
    return rows


class _Memo(dict):
    """A dictionary that computes what it lacks."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, key):
        self[key] = value = self.function(key)
        return value

    def __reduce__(self):
        return _Memo, (self.function,)


class Crf:
    """Linear-chain CRF with label-feature weights for a word, its predecessor and its successor."""

    def __init__(self, rows: Sequence[tuple[list[str], list[str]]], rounds: int = 100, l2: float = 0.02) -> None:
        self.names = {f: i for i, f in enumerate(sorted({f for words, _ in rows for w in words for f in word_features(w)}))}
        n, size = len(self.names) + 1, len(LABELS)  # the last row stands for the end of a line
        self.weights, self.moves, self.begin = np.zeros((3, n, size)), np.zeros((size, size)), np.zeros(size)
        # One padded batch of all lines: (line, position, feature) indicator products.
        longest = max(len(w) for w, _ in rows)
        x = np.zeros((len(rows), longest + 2, n))
        y = np.zeros((len(rows), longest), dtype=np.int64)
        mask = np.zeros((len(rows), longest), dtype=bool)
        x[:, 0, -1] = 1
        for k, (words, labels) in enumerate(rows):
            for t, w in enumerate(words):
                x[k, t + 1, [self.names[f] for f in word_features(w)]] = 1
            x[k, len(words) + 1, -1] = 1
            y[k, : len(words)], mask[k, : len(words)] = [LABELS.index(v) for v in labels], True
        views = [x[:, 1:-1], x[:, :-2], x[:, 2:]]
        parameters = [self.weights, self.moves, self.begin]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for step in range(1, rounds + 1):  # Adam
            for p, g, m, v in zip(parameters, self._gradient(views, y, mask, l2 * len(rows) / 100), first, second, strict=True):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self._classes: dict[tuple[str, ...], int] = {}
        self._tables: list[np.ndarray] = []
        self._known = _Memo(self._class_of)

    def _gradient(self, views, y, mask, l2):
        """Of the log likelihood with an L2 penalty, by forward and backward sums."""
        emit = sum(v @ w for v, w in zip(views, self.weights, strict=True))
        lines, longest, size = emit.shape
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        add = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
        forward[:, 0] = emit[:, 0] + self.begin
        for t in range(1, longest):
            new = emit[:, t] + add(forward[:, t - 1, :, None] + self.moves, 1)
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = add(self.moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = add(forward[:, -1], 1)
        marginal = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        gold = np.eye(size)[y] * mask[:, :, None]
        rest = gold - marginal
        weights = np.stack([np.einsum("ktf,ktl->fl", v, rest) for v in views]) - l2 * self.weights
        pair = np.exp(
            forward[:, :-1, :, None] + self.moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * mask[:, 1:, None, None]
        seen = np.einsum("kta,ktb->ab", gold[:, :-1] * mask[:, 1:, None], gold[:, 1:])
        return [weights, seen - pair.sum(axis=(0, 1)) - l2 * self.moves, rest[:, 0].sum(axis=0) - l2 * self.begin]

    # -------------------------------------------------------- decoding

    def _class_of(self, word: str) -> int:
        features = word_features(word)
        k = self._classes.get(features)
        if k is None:
            k = self._classes[features] = len(self._classes)
            at = [self.names[f] for f in features if f in self.names]
            self._tables.append(self.weights[:, at].sum(axis=1))
        return k

    def classes(self, words: list[str]) -> np.ndarray:
        """A small number for each word: words with equal features share it."""
        if len(self._known) > 500_000:
            self._known.clear()
        return np.fromiter(map(self._known.__getitem__, words), dtype=np.int64, count=len(words))

    def decode(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels of words in lines: line k has the words from first[k] to first[k + 1]."""
        labels = np.zeros(len(classes), dtype=np.int8)
        if not len(classes):
            return labels
        table = np.r_[np.stack(self._tables), self.weights[None, :, -1]]  # class -1 is the edge of a line
        sizes = np.diff(first)
        before, after = np.r_[-1, classes[:-1]], np.r_[classes[1:], -1]
        before[first[:-1][sizes > 0]], after[first[1:][sizes > 0] - 1] = -1, -1
        # A path of O alone is best where no word gains by another label, whatever the moves around it.
        most = (table[:, :, 1:] - table[:, :, :1]).max(axis=2)
        gain = most[classes, 0] + most[before, 1] + most[after, 2] + self._bonus()
        line = np.repeat(np.arange(len(sizes)), sizes)
        open_lines = np.unique(line[gain > 0])
        open_lines = open_lines[np.argsort(-sizes[open_lines], kind="stable")]
        lengths, begins = sizes[open_lines], first[open_lines]
        if not len(open_lines):
            return labels
        emit_of = lambda at: table[classes[at], 0] + table[before[at], 1] + table[after[at], 2]
        back, best = np.zeros((len(classes), len(LABELS)), dtype=np.int8), emit_of(begins) + self.begin
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lines longer than t
        for t in range(1, int(lengths[0])):
            n, at = alive[t], begins[: alive[t]] + t
            scores = best[:n, :, None] + self.moves
            back[at] = scores.argmax(axis=1)
            best[:n] = scores.max(axis=1) + emit_of(at)
        current = best.argmax(axis=1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = alive[t]
            at = begins[:n] + t
            labels[at] = current[:n]
            current[:n] = back[at, current[:n]]
        return labels

    def _bonus(self) -> float:
        """The most that moves can add per word of a run of other labels, against staying at O."""
        stay = self.moves[0, 0]
        inside = (self.moves[1:, 1:] - stay).max()
        enter = max((self.moves[0, 1:] - stay).max(), (self.begin[1:] - self.begin[0]).max())
        leave = max((self.moves[1:, 0] - stay).max(), 0.0)
        return float(max(inside, enter + leave))

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of each text, from the words of its lines."""
        words, first, lines_of = [], [0], []
        for text in texts:
            lines = text.split("\n")
            for line in lines:
                words += line.split()
                first.append(len(words))
            lines_of.append(len(lines))
        first_array = np.array(first, dtype=np.int64)
        labels = self.decode(self.classes(words), first_array)
        marked = np.unique(np.searchsorted(first_array, np.flatnonzero(labels), side="right") - 1).tolist()
        out: list[list[Span]] = [[] for _ in texts]
        text_of_line = np.cumsum(np.r_[0, lines_of])
        current, lines, starts = -1, [], np.zeros(0, dtype=np.int64)
        for k in marked:
            t = int(np.searchsorted(text_of_line, k, side="right")) - 1
            if t != current:
                current, lines = t, texts[t].split("\n")
                starts = np.cumsum([0, *(len(line) + 1 for line in lines)])
            number = k - int(text_of_line[t])
            at, open_span = int(starts[number]), False  # a span never reaches over a line's end
            for m, label in zip(re.finditer(r"\S+", _as_split(lines[number])), labels[first[k] : first[k + 1]].tolist(), strict=True):
                a, b = at + m.start(), at + m.start() + len(m[0].rstrip(".,;:!?"))
                if label == 2 and open_span:
                    out[t][-1] = ("crf", out[t][-1][1], b)
                elif label:
                    out[t].append(("crf", a, b))
                open_span = bool(label)
        return out


def _as_split(line: str) -> str:
    """The line with every character that str.split() cuts at as a plain space, so that positions stay."""
    return "".join(" " if c.isspace() else c for c in line) if not line.isascii() or not line.isprintable() else line


_MODELS: dict[int, Crf] = {}


def default_model() -> Crf:
    """The CRF of the template lines and the written lines (four times each), trained once per process."""
    if 0 not in _MODELS:
        _MODELS[0] = Crf(training_table() + 4 * labelled_lines())
    return _MODELS[0]


def find_spans(texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, CRF spans outside them) of each text."""
    out = []
    for text, extra in zip(texts, model.spans(texts), strict=True):
        base = base_spans(text)
        out.append((base, outside([s for s in extra if s[1] < s[2]], base)))
    return out


def redact_documents(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """The table with every span in ``text`` replaced by its kind; n_chars, if there, follows.  Narrow: no shuffle."""
    model = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = find_spans([t or "" for t in texts], model)
        clean = [None if t is None else redact(t, base + extra) for t, (base, extra) in zip(texts, found, strict=True)]
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["text"] = pa.array(clean, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in clean], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_slices(docs, run, docs.schema)


def scan(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Per document (doc_id, text): counts per kind, base_sha256 and all spans.  Narrow: no shuffle.

    The trained model goes to the tasks with the function; its size does not depend on the data.
    """
    model = model or default_model()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_crf long, base_sha256 string, spans string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = batch.column("text").to_pylist(), []
        for text, (base, extra) in zip(texts, find_spans([t or "" for t in texts], model), strict=True):
            row = [sum(s[0] == k for s in base) for k in KINDS[:4]]
            row += [len(extra), digest(base, KINDS), joined(base + extra, KINDS)]
            rows.append(row)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return map_slices(docs.select("doc_id", "text"), run, schema)
