"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans: sentences made by a seeded
generator, in which addresses, numbers and look-alikes stand at known places.
Overlapping windows cover every text whole, and all of them are decoded by
Viterbi; each character then takes the label from the window in which it stands
furthest from an edge, so that spans are the same wherever windows begin.

Spans of the fixed patterns always stay; the model adds spans where no pattern
matched.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .shared import texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The base patterns.  A number is tried from its first digit only, an
# address from each @, so that long runs take no more than linear time; the matches are the same.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = re.sub(r"[^0-9]", "", match)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, found from each @ leftwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1  # no address reaches over an @
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start; a match that fails its test is dropped."""
    out = [(0, a, z) for a, z in addresses(text)]
    for n, kind in enumerate(KINDS):
        if kind in PATTERNS:
            out += [(n, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _holds(kind, m[0])]
    return out


# Characters the tagger tells apart; other ASCII is one class, non-ASCII another.
MARKS = " \n.,@+-_()[]{}:;/%#=\"'!?$&*|"
_CHARS = np.full(0x80, len(MARKS) + 4, np.int64)
for _i, _c in enumerate(MARKS):
    _CHARS[ord(_c)] = _i
_CHARS[ord("a") : ord("z") + 1] = len(MARKS)
_CHARS[ord("A") : ord("Z") + 1] = len(MARKS) + 1
_CHARS[ord("0") : ord("9") + 1] = len(MARKS) + 2
CLASSES = len(MARKS) + 6  # non-ASCII, other ASCII and padding come last
PAD = CLASSES - 1


_BYTES = np.full(256, len(MARKS) + 3, np.uint8)  # the class of a code point by its first byte
_BYTES[:0x80] = _CHARS


def char_classes(text: str | bytes | np.ndarray) -> np.ndarray:
    """Classes of the code points of a text or its UTF-8 bytes."""
    if isinstance(text, str):
        text = text.encode("utf-8", "replace")
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    return _BYTES[data[(data & 0xC0) != 0x80]]


class Tagger:
    """Bidirectional LSTM over character classes with a CRF on top; both directions share one time loop.

    Gates are hard sigmoids, clip(x / 4 + 1/2, 0, 1), and states hard tangents,
    clip(x, -1, 1), in training as in decoding.
    """

    def __init__(self, hidden: int = 16, width: int = 10, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(LABELS)
        self.hidden = hidden
        self.p = {
            "embed": rng.normal(0, 0.5, (CLASSES, width)),
            "x": rng.normal(0, 0.3, (2, width, 4 * hidden)),
            "h": rng.normal(0, 0.3, (2, hidden, 4 * hidden)),
            "b": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], hidden), (2, 1))[:, None, :],
            "out": rng.normal(0, 0.3, (2 * hidden, n)),
            "bias": np.zeros(n),
            "go": np.zeros((n, n)),
        }
        # transitions that no labelling has: into the inside of a kind from anywhere but that kind
        self.banned = np.zeros((n, n))
        for k in range(len(KINDS)):
            inside = 2 * k + 2
            self.banned[[i for i in range(n) if i not in (inside - 1, inside)], inside] = -1e4
        self.first = np.array([0.0 if not label.startswith("I") else -1e4 for label in LABELS])

    def _run(self, x: np.ndarray, keep: bool = False):
        p, (b, t), h = self.p, x.shape, self.hidden
        e = p["embed"][x]
        both = np.stack((e, e[:, ::-1]))  # direction, row, time, width
        inputs = np.matmul(both.reshape(2, b * t, -1), p["x"]).reshape(2, b, t, 4 * h) + p["b"][:, :, None, :]
        state, cell = np.zeros((2, b, h), e.dtype), np.zeros((2, b, h), e.dtype)
        outs, saved = np.empty((2, b, t, h), e.dtype), []
        for i in range(t):
            z = inputs[:, :, i] + np.matmul(state, p["h"])
            z[..., : 3 * h] = np.clip(z[..., : 3 * h] / 4 + 0.5, 0, 1)
            z[..., 3 * h :] = np.clip(z[..., 3 * h :], -1, 1)
            before, old = state, cell
            cell = z[..., h : 2 * h] * cell + z[..., :h] * z[..., 3 * h :]
            squashed = np.clip(cell, -1, 1)
            state = z[..., 2 * h : 3 * h] * squashed
            outs[:, :, i] = state
            if keep:
                saved.append((z, before, old, squashed))
        joined = np.concatenate((outs[0], outs[1][:, ::-1]), axis=2)
        return joined @ p["out"] + p["bias"], joined, both, saved

    def _loss(self, scores: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log likelihood of the CRF and its gradients by scores and transitions."""
        b, t, n = scores.shape
        go = self.p["go"] + self.banned
        alpha = np.empty((b, t, n))
        alpha[:, 0] = scores[:, 0] + self.first

        def logsum(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis))

        for i in range(1, t):
            alpha[:, i] = logsum(alpha[:, i - 1, :, None] + go, 1) + scores[:, i]
        beta = np.zeros((b, t, n))
        for i in range(t - 2, -1, -1):
            beta[:, i] = logsum(go + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        total = logsum(alpha[:, -1], 1)
        rows = np.arange(b)[:, None]
        gold = scores[rows, np.arange(t), y].sum(1) + go[y[:, :-1], y[:, 1:]].sum(1)
        d = np.exp(alpha + beta - total[:, None, None])
        d[rows, np.arange(t), y] -= 1
        d_go = np.zeros((n, n))
        for i in range(1, t):
            d_go += np.exp(alpha[:, i - 1, :, None] + go + (scores[:, i] + beta[:, i])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(d_go, (y[:, :-1], y[:, 1:]), -1)
        return float((total - gold).mean()), d / b, d_go / b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (b, t), h = self.p, x.shape, self.hidden
        scores, joined, both, saved = self._run(x, keep=True)
        loss, d, d_go = self._loss(scores, y)
        g = {"go": d_go, "bias": d.sum((0, 1)), "out": joined.reshape(b * t, -1).T @ d.reshape(b * t, -1), "h": np.zeros_like(p["h"])}
        back = d @ p["out"].T
        d_out = np.stack((back[..., :h], back[:, ::-1, h:]))
        d_z = np.empty((2, b, t, 4 * h))
        d_state, d_cell = np.zeros((2, b, h)), np.zeros((2, b, h))
        for i in range(t - 1, -1, -1):
            z, before, old, squashed = saved[i]
            gate_in, gate_forget, gate_out, new = (z[..., k * h : (k + 1) * h] for k in range(4))
            d_state = d_state + d_out[:, :, i]
            d_cell = d_cell + d_state * gate_out * (np.abs(squashed) < 1)
            own = np.concatenate((d_cell * new, d_cell * old, d_state * squashed, d_cell * gate_in), axis=2)
            own[..., : 3 * h] *= 0.25 * ((z[..., : 3 * h] > 0) & (z[..., : 3 * h] < 1))
            own[..., 3 * h :] *= np.abs(new) < 1
            d_z[:, :, i] = own
            g["h"] += np.matmul(before.transpose(0, 2, 1), own)
            d_state = np.matmul(own, p["h"].transpose(0, 2, 1))
            d_cell = d_cell * gate_forget
        flat = d_z.reshape(2, b * t, 4 * h)
        g["b"] = flat.sum(1)[:, None, :]
        g["x"] = np.matmul(both.reshape(2, b * t, -1).transpose(0, 2, 1), flat)
        d_e = np.matmul(flat, p["x"].transpose(0, 2, 1)).reshape(2, b, t, -1)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x, d_e[0] + d_e[1][:, ::-1])
        return loss, g

    def for_decoding(self) -> Tagger:
        """The weights as decoding takes them, rows last: inputs by class, and the gates' scale and shift folded in."""
        h = self.hidden
        scale = np.where(np.arange(4 * h) < 3 * h, 0.25, 1.0)
        shift = np.where(np.arange(4 * h) < 3 * h, 0.5, 0.0)
        of_class = (self.p["embed"] @ self.p["x"] + self.p["b"]) * scale + shift
        self.by_class = of_class.astype(np.float32)
        self.by_state = np.ascontiguousarray((self.p["h"] * scale).transpose(0, 2, 1), np.float32)
        self.to_labels = np.ascontiguousarray(self.p["out"].T, np.float32)
        self.label_bias = self.p["bias"].astype(np.float32)
        self.go = (self.p["go"] + self.banned).astype(np.float32)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Label scores (time, label, row) of windows of classes."""
        (b, t), h = x.shape, self.hidden
        state, cell = np.zeros((2, h, b), np.float32), np.zeros((2, h, b), np.float32)
        outs, z = np.empty((2, t, h, b), np.float32), np.empty((2, 4 * h, b), np.float32)
        at, more = np.ascontiguousarray(x.T), np.empty((2, h, b), np.float32)
        # bounds as whole arrays, which numpy compares several numbers at a time
        high, low = np.ones_like(z), np.zeros_like(z)
        low[:, 3 * h :] = -1
        for i in range(t):
            np.matmul(self.by_state, state, out=z)
            z[0] += self.by_class[0].take(at[i], axis=0).T
            z[1] += self.by_class[1].take(at[t - 1 - i], axis=0).T
            np.minimum(z, high, out=z)
            np.maximum(z, low, out=z)
            cell *= z[:, h : 2 * h]
            np.multiply(z[:, :h], z[:, 3 * h :], out=more)
            cell += more
            np.minimum(cell, high[:, :h], out=state)
            np.maximum(state, low[:, 3 * h :], out=state)
            state *= z[:, 2 * h : 3 * h]
            outs[0, i], outs[1, t - 1 - i] = state
        both = np.matmul(self.to_labels[:, :h], outs[0])
        both += np.matmul(self.to_labels[:, h:], outs[1])
        both += self.label_bias[:, None]
        return both

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label sequence of each window, by Viterbi: the best scores forwards, then the path backwards.

        A window whose best score is that of all O has no path to follow.
        """
        best = self.scores(x)
        t, _, b = best.shape
        to = np.ascontiguousarray(self.go.T)[:, :, None]
        begins, insides = [0, *range(1, len(LABELS), 2)], range(2, len(LABELS), 2)  # an inside follows its own kind only
        to_begin = to[begins]
        from_begin, from_inside = (np.array([self.go[k - d, k] for k in insides])[:, None] for d in (1, 0))
        best[0] += self.first.astype(np.float32)[:, None]
        all_o = best[0, 0].copy()
        for i in range(1, t):
            before, now = best[i - 1], best[i]
            all_o += self.go[0, 0]
            all_o += now[0]
            now[begins] += (before + to_begin).max(axis=1)
            now[2::2] += np.maximum(before[1::2] + from_begin, before[2::2] + from_inside)
        out = np.zeros((b, t), np.int8)
        last = best[-1].argmax(0)
        some = np.flatnonzero((last > 0) | (best[-1, 0] > all_o))
        if not len(some):
            return out
        best, path = np.ascontiguousarray(best[:, :, some].transpose(0, 2, 1)), np.empty((t, len(some)), np.int8)
        path[-1], to = last[some], to[:, :, 0]
        for i in range(t - 1, 0, -1):
            path[i - 1] = (best[i - 1] + to[path[i]]).argmax(1)
        out[some] = path.T
        return out


def labelled_text(rng: random.Random, size: int) -> tuple[str, list[int]]:
    """A text of `size` characters and the label of each."""

    def word() -> str:
        return "".join(rng.choice("abcdefghilmnoprstuvwéüñß") for _ in range(rng.randint(1, 9)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = digits(15)
        full = body + next(c for c in "0123456789" if luhn(body + c))
        return rng.choice((full, "-".join(full[i : i + 4] for i in range(0, 16, 4)), " ".join(full[i : i + 4] for i in range(0, 16, 4))))

    def email() -> str:
        name = rng.choice((word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}+{word()}")).encode("ascii", "ignore").decode() or "a"
        at = rng.choice(("@", "@", "@", " at ", " [at] "))
        return f"{name}{at}{rng.choice(('mail', 'example', 'web', 'host'))}{rng.choice(('', digits(1)))}.{rng.choice(('example.com', 'org', 'net', 'co.uk'))}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+1.{a}.{b}.{c}"))

    def ip() -> str:
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))

    def other() -> str:
        return rng.choice((
            digits(rng.randint(1, 6)), f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}",
            f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"${digits(3)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"#{digits(5)}", f"{digits(20)}", f"@{word()}",
        ))

    make = (email, ip, card, phone)
    text, labels = "", []
    while len(text) < size:
        roll = rng.random()
        if roll < 0.22:
            k = rng.randrange(4)
            part = make[k]()
            labels += [2 * k + 1, *[2 * k + 2] * (len(part) - 1)]
        else:
            part = other() if roll < 0.3 else word()
            labels += [0] * len(part)
        gap = rng.choice((" ", " ", " ", " ", ". ", ", ", "\n", "### ", "!! "))
        text += part + gap
        labels += [0] * len(gap)
    return text[:size], labels[:size]


@functools.cache
def trained_tagger(steps: int = 400, batch: int = 48, window: int = 48, rate: float = 0.04, seed: int = 11) -> Tagger:
    """The tagger after Adam on generated texts; the same on every call."""
    rng = random.Random(seed)
    tagger = Tagger(seed=seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(x) for k, x in tagger.p.items()}
    for t in range(1, steps + 1):
        made = [labelled_text(rng, window) for _ in range(batch)]
        x = np.array([char_classes(text) for text, _ in made])
        y = np.array([labels for _, labels in made])
        _, g = tagger.gradients(x, y)
        norm = np.sqrt(sum(float((q**2).sum()) for q in g.values()))
        now = rate * min(1.0, 5 / norm) * (1 - t / steps * 0.9)
        for k, q in g.items():
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q**2
            tagger.p[k] = tagger.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return tagger.for_decoding()


def tag(model: Tagger, classes: list[np.ndarray], window: int, stride: int, batch: int) -> list[np.ndarray]:
    """The label of every character of each text: windows start every stride characters, and the most central one counts."""
    edge = (window - stride) // 2
    out = [np.zeros(len(c), np.int8) for c in classes]
    places = [(r, s) for r, c in enumerate(classes) for s in range(0, max(len(c) - (window - stride), 1), stride) if len(c)]
    for low in range(0, len(places), batch):
        some = places[low : low + batch]
        x = np.full((len(some), window), PAD, np.uint8)
        for i, (r, s) in enumerate(some):
            piece = classes[r][s : s + window]
            x[i, : len(piece)] = piece
        for (r, s), labels in zip(some, model.decode(x), strict=True):
            a = s + edge if s else 0
            z = min(s + window if s + window >= len(classes[r]) else s + edge + stride, len(classes[r]))
            out[r][a:z] = labels[a - s : z - s]
    return out


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the labelled runs: one starts at a B, or at an I that does not go on from its kind."""
    at = np.flatnonzero(labels)
    kind, inside = (labels[at] - 1) // 2, labels[at] % 2 == 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | ~inside[1:]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(kind[first].tolist(), at[first].tolist(), (at[last] + 1).tolist(), strict=True)) if len(at) else []


def plausible(kind: int, text: str) -> bool:
    """Least that a span of the model must show to count: enough digits, or the parts of an address."""
    digits = sum(c.isdigit() for c in text)
    return (len(text) >= 6 and ("@" in text or " at " in text or "[at]" in text) and "." in text, text.count(".") == 3 and 4 <= digits <= 12, 13 <= digits <= 19, 7 <= digits <= 15)[kind]


def _added(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's spans that are plausible and touch no base span."""
    covered = np.zeros(len(text) + 1, np.int64)
    for _, a, z in base:
        covered[a:z] = 1
    before = np.concatenate(([0], np.cumsum(covered)))
    return [(k, a, z) for k, a, z in spans_of(labels) if before[z] == before[a] and plausible(k, text[a:z])]


def personal_data(docs: DataFrame, window: int = 160, stride: int = 128, batch: int = 2048, doc_id: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are those of the base patterns; spans adds what the
    model finds where no base span is.  Spans are kind:start:end in code
    points, end exclusive, by kind, then start, joined by commas.  A null or
    empty text has none; an empty table has no rows.  Only texts are read;
    repeated rows are reported each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained_tagger())

    def text_of(spans: list) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(b.column(1), lower=False):
                parts = [s.data[x:y] for x, y in itertools.pairwise(s.bounds.tolist())]
                tagged = tag(shared.value, [char_classes(x) for x in parts], window, stride, batch)
                whole = [x.tobytes().decode("utf-8", "replace") for x in parts]
                base = [base_spans(t) for t in whole]
                more = [_added(t, labels, own) if labels.any() else [] for t, labels, own in zip(whole, tagged, base, strict=True)]
                counts = [pa.array([sum(k == n for k, _, _ in spans) for spans in base], pa.int64()) for n in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(text_of(spans).encode()).hexdigest() for spans in base])
                spans = pa.array([text_of([*x, *y]) for x, y in zip(base, more, strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.hi - s.lo), *counts, digests, spans], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return texts(docs, doc_id=doc_id, text=text).mapInArrow(run, schema)
