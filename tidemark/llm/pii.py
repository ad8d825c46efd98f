"""Personal data: exact base rules, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger is trained in numpy on windows of a bounded sample, labelled by the base rules and by spans written into them
in further layouts. Texts are cut into overlapping windows on a fixed grid, whose emissions are joined: a place takes the mean of
the windows that hold it, weighted towards their middles. One Viterbi pass then decodes each whole run of overlapping windows, however
long, so tags agree across windows. A span must hold a digit or an "@", so a window without either is all "outside"; it
is not computed, and ends a run. A span that begins or ends within a run of digits takes all of the run. Added spans must satisfy the
kind's own check (of a phone number, 9 to 15 digits; of a card, Luhn) and may not touch a base span.

Base rules, leftmost and non-overlapping for each kind, on whole texts; offsets count code points, ends are exclusive.

Defined cases: a null text is empty and has no spans; long texts cost time in proportion (no rule backtracks over its
run; a run of windows holds 80 bytes a place); rows are judged one by one; an empty sample gives the base rules alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 1500
SAMPLE_WINDOWS = 3000
WRITINGS = 4  # windows at each place, with other values written in
WIDTH, STRIDE, UNITS = 64, 32, 16
BATCH = 2048  # windows computed at a time
N_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUNS = re.compile(r"[0-9+][0-9+ ().\-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d // 5 + 2 * d % 10 for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _fits(kind: str, text: str) -> bool:
    if kind == "email":
        return _DOMAIN.search(text) is not None
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in parts)
    found = _digits(text)
    return 12 <= len(found) <= 19 and luhn(found) if kind == "card" else 9 <= len(found) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in that order."""
    spans, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            spans.append((start, 0, m.end()))
            free = after = m.end()
        at = text.find("@", after)
    for run in _RUNS.finditer(text):
        begin, piece = run.start(), run.group()
        for kind, rule in ((1, _IP), (2, _CARD), (3, _PHONE)):
            for m in rule.finditer(piece):
                if _fits(KINDS[kind], m.group()):
                    spans.append((begin + m.start(), kind, begin + m.end()))
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- the tagger


def _classes() -> np.ndarray:
    """Code points below 256 to classes; the rest share a class with other letters."""
    table = np.full(256, 1, np.uint8)
    table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 2
    table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 3
    table[[ord(c) for c in "0123456789"]] = 4
    for k, c in enumerate("@.+-() \n,_%:/"):
        table[ord(c)] = 5 + k
    table[ord("0")] = N_CLASSES - 1  # many phone numbers begin with it
    return table


N_CLASSES = 19  # 0 is beyond the text
_CLASS = _classes()
_SPACE = int(_CLASS[32])


def _encoded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.where(points < 256, points, 255)]


@dataclass
class Tagger:
    """Weights: for each direction input (class x 4 units), recurrent and bias; then output and transitions."""

    weights: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        states = [_run_lstm(x if d == "f" else x[:, ::-1], w["x" + d], w["h" + d], w["b" + d])[0] for d in "fb"]
        return np.concatenate([states[0], states[1][:, ::-1]], 2) @ w["o"] + w["c"]

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Emissions of runs, longest first, each up to its length -> their best tags, by Viterbi over the whole of each run."""
        t = self.weights["t"]
        n, width, _ = emissions.shape
        score = emissions[:, 0].copy()
        back = np.broadcast_to(np.arange(N_TAGS, dtype=np.int8), (n, width, N_TAGS)).copy()
        alive = np.searchsorted(-lengths, -np.arange(width))  # runs longer than each place
        for k in range(1, width):
            m = alive[k]
            step = score[:m, :, None] + t
            back[:m, k] = step.argmax(1)
            score[:m] = step.max(1) + emissions[:m, k]
        tags = np.zeros((n, width), np.int8)
        tags[:, -1] = score.argmax(1)
        for k in range(width - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(n), k, tags[:, k]]
        tags[np.arange(width)[None] >= lengths[:, None]] = 0
        return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run_lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    n, width = x.shape
    u = wh.shape[0]
    h = c = np.zeros((n, u), np.float32)
    states, kept = np.empty((n, width, u), np.float32), []
    for k in range(width):
        z = wx[x[:, k]] + h @ wh + b
        gates, g = _sigmoid(z[:, : 3 * u]), np.tanh(z[:, 3 * u :])
        i, f, o = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :]
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[:, k] = h
        kept.append((i, f, o, g, tc, before))
    return states, kept


def _back_lstm(x: np.ndarray, wh: np.ndarray, kept: list, grad: np.ndarray, n_classes: int):
    n, width, u = grad.shape
    gx, gh, gb = np.zeros((n_classes, 4 * u), np.float32), np.zeros_like(wh), np.zeros(4 * u, np.float32)
    dh = dc = np.zeros((n, u), np.float32)
    each = np.eye(n_classes, dtype=np.float32)
    for k in range(width - 1, -1, -1):
        i, f, o, g, tc, (h0, c0) = kept[k]
        dh = dh + grad[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        gx += each[x[:, k]].T @ dz
        gh += h0.T @ dz
        gb += dz.sum(0)
        dh, dc = dz @ wh.T, dc * f
    return gx, gh, gb


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _crf(e: np.ndarray, t: np.ndarray, y: np.ndarray):
    """Negative log likelihood a window, and its gradients for emissions and transitions."""
    n, width, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for k in range(1, width):
        alpha[:, k] = _log_sum(alpha[:, k - 1][:, :, None] + t, 1) + e[:, k]
    for k in range(width - 2, -1, -1):
        beta[:, k] = _log_sum(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
    total = _log_sum(alpha[:, -1], 1)
    ge = np.exp(alpha + beta - total[:, None, None])
    pairs = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - total[:, None, None, None])
    gt = pairs.sum((0, 1))
    rows = np.arange(n)[:, None]
    gold = np.take_along_axis(e, y[..., None], 2).sum((1, 2)) + t[y[:, :-1], y[:, 1:]].sum(1)
    ge[rows, np.arange(width)[None], y] -= 1
    np.subtract.at(gt, (y[:, :-1], y[:, 1:]), 1)
    return (total - gold).mean(), ge / n, gt / n


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, seed: int = 5) -> Tagger:
    """Adam over random batches of labelled windows."""
    rng = np.random.default_rng(seed)
    new = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
    w = {k + d: new(*s) for d in "fb" for k, s in (("x", (N_CLASSES, 4 * UNITS)), ("h", (UNITS, 4 * UNITS)))}
    w |= {"b" + d: np.zeros(4 * UNITS, np.float32) for d in "fb"} | {"o": new(2 * UNITS, N_TAGS), "c": np.zeros(N_TAGS, np.float32), "t": np.zeros((N_TAGS, N_TAGS), np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), batch)
        bx, by = x[at], y[at].astype(np.int64)
        sf, kf = _run_lstm(bx, w["xf"], w["hf"], w["bf"])
        sb, kb = _run_lstm(bx[:, ::-1], w["xb"], w["hb"], w["bb"])
        both = np.concatenate([sf, sb[:, ::-1]], 2)
        _, ge, gt = _crf(both @ w["o"] + w["c"], w["t"], by)
        ge = ge.astype(np.float32)
        g = {"o": both.reshape(-1, 2 * UNITS).T @ ge.reshape(-1, N_TAGS), "c": ge.sum((0, 1)), "t": gt}
        gs = ge @ w["o"].T
        g["xf"], g["hf"], g["bf"] = _back_lstm(bx, w["hf"], kf, gs[:, :, :UNITS], N_CLASSES)
        g["xb"], g["hb"], g["bb"] = _back_lstm(bx[:, ::-1], w["hb"], kb, gs[:, ::-1, UNITS:], N_CLASSES)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, a in w.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Tagger(w)


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for a, kind, b in sorted(spans, key=lambda s: s[2] - s[0]):
        tags[a:b], tags[a] = 2 + 2 * kind, 1 + 2 * kind
    return tags


#: Layouts that are written into training windows: "d" is any digit, "C" a digit of a card number. The second list is harmless.
LAYOUTS = {
    "phone": (
        "(ddd) ddd-dddd", "(ddd) ddd dddd", "(ddd)ddd-dddd", "ddd-ddd-dddd", "ddd ddd dddd", "+dd ddd ddd dddd", "+d (ddd) ddd-dddd", "+dd-ddd-ddddddd",
        "0dd dddd dddd", "0ddd ddd ddd", "0ddd-dddddd", "dd dd dd dd dd", "00dd ddd dddddd", "d-ddd-ddd-dddd", "d (ddd) ddd-dddd", "ddd.ddd.dddd", "dd.dd.dd.dd.dd",
        "(0ddd) dddddd", "0dddd/dddddd", "0dd ddddddd", "0dddd dddddd", "0ddd ddd dddd", "0ddd-dddd-ddd", "00dd dd dddd dddd", "ddd/ddd-dddd", "+dd (d) ddd dddddd",
    ),
    "card": (
        "CCCCCCCCCCCCCCCC", "CCCC CCCC CCCC CCCC", "CCCC-CCCC-CCCC-CCCC", "CCCC.CCCC.CCCC.CCCC", "CCCC/CCCC/CCCC/CCCC", "CCCC_CCCC_CCCC_CCCC", "CCCC CCCCCC CCCCC",
        "CCCC-CCCCCC-CCCCC", "CCCC.CCCCCC.CCCCC", "CCCC:CCCC:CCCC:CCCC", "CCCCCC CCCCCCCCCC", "CCCC  CCCC  CCCC  CCCC", "CCCC CCCC CCCC CCC",
    ),
    "ip": ("n.n.n.n",),
    "email": ("w.w@w.w", "w@w.w", "wd@w.w.w"),
}
HARMLESS = (
    "dddd-dd-dd", "dd/dd/dddd", "dd.dd.dddd", "dd:dd:dd", "dd:dd", "d.dd", "dddd", "ddddd", "d,ddd,ddd", "d.d.d", "dd%", "ddd-ddd", "dddd-dddd", "n.n.n", "No. ddddd", "p. ddd-ddd",
    "dddd/dd", "@w", "w@", "w @ w", "dd x dd", "dddd dddd", "ddddddd", "d d d d", "$ddd.dd", "#dddd", "dd-dd",
)


def filled(layout: str, rng: np.random.Generator) -> str:
    """A layout with random digits, words (w) and numbers to 255 (n); card digits pass Luhn."""
    out = [str(rng.integers(10)) if c in "dC" else str(rng.integers(256)) if c == "n" else "".join(rng.choice(list("abcdefgiklmnoprstu"), int(rng.integers(2, 8)))) if c == "w" else c for c in layout]
    at = [k for k, c in enumerate(layout) if c == "C"]
    if at:
        out[at[0]] = "4"
        out[at[-1]] = next(k for k in "0123456789" if luhn("".join(out[i] for i in at[:-1]) + k))
    return "".join(out)


def _variants(rng: np.random.Generator) -> tuple[str, int]:
    """A value in one of the layouts, and its kind; -1 is none."""
    kind = int(rng.choice(5, p=[0.06, 0.08, 0.26, 0.34, 0.26]))
    layouts = HARMLESS if kind == 4 else LAYOUTS[KINDS[kind]]
    return filled(layouts[int(rng.integers(len(layouts)))], rng), -1 if kind == 4 else kind


def training_windows(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows around the sample's digits and at-signs, most of them with one or two further values written in."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for text in texts:
        spans = base_spans(text)
        classes, tags = _encoded(text), tags_of(len(text), spans)
        ends = [b for _, _, b in spans]
        for at in ([m.start() for m in _TRIGGER.finditer(text)][::9][:20] + ends[:6]) * WRITINGS:
            lo = max(0, at - int(rng.integers(8, 56)))
            x, y = classes[lo : lo + WIDTH], tags[lo : lo + WIDTH]
            for _ in range(int(rng.integers(0, 3))):
                value, kind = _variants(rng)
                gaps = np.flatnonzero((x[:-1] == _SPACE) & (y[:-1] == 0))  # a space that is in no span
                cut = int(rng.choice(gaps)) + 1 if len(gaps) else 0
                own = tags_of(len(value), [(0, kind, len(value))]) if kind >= 0 else np.zeros(len(value), np.int8)
                mark = " " if rng.random() < 0.6 else str(rng.choice([". ", ", ", ") ", "\n", "; "]))
                x = np.concatenate([x[:cut], _encoded(value + mark), x[cut:]])[:WIDTH]
                y = np.concatenate([y[:cut], own, np.zeros(len(mark), np.int8), y[cut:]])[:WIDTH]
            xs.append(np.pad(x, (0, WIDTH - len(x))))
            ys.append(np.pad(y, (0, WIDTH - len(y))))
    order = rng.permutation(len(xs))[:SAMPLE_WINDOWS]
    return np.array(xs, np.uint8).reshape(-1, WIDTH)[order], np.array(ys, np.int8).reshape(-1, WIDTH)[order]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """From the texts with a digit or "@" among about SAMPLE_DOCS documents, chosen by a hash of their ids."""
    some = hashed_sample(docs.select(id_col, text_col), SAMPLE_DOCS).filter(F.col(text_col).rlike("[0-9@]")).select(text_col)
    x, y = training_windows(sorted(r[0] for r in some.collect()))
    return fit(x, y) if len(x) >= 20 else None


def _joint(tagger: Tagger, own: list[np.ndarray], runs: list[tuple[int, int, int]], places: int) -> np.ndarray:
    """Emissions of runs (text, first start, windows) over all their places: the mean of the windows that hold a place, weighted by
    how far inside the window it lies.
    """
    sums, weights = np.zeros((len(runs), places, N_TAGS), np.float32), np.zeros((len(runs), places, 1), np.float32)
    inside = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)[:, None]
    jobs = [(r, k) for r, (_, _, many) in enumerate(runs) for k in range(many)]
    for lo in range(0, len(jobs), BATCH):
        part = jobs[lo : lo + BATCH]
        starts = [runs[r][1] + (k + 1) * STRIDE for r, k in part]  # texts have STRIDE places before them
        found = tagger.emissions(np.array([own[runs[r][0]][s : s + WIDTH] for (r, _), s in zip(part, starts, strict=True)]))
        for (r, k), e in zip(part, found, strict=True):
            at = slice(k * STRIDE, k * STRIDE + WIDTH)
            sums[r, at] += inside * e
            weights[r, at] += inside
    return sums / np.maximum(weights, 1)


def _runs_of(text: str) -> list[tuple[int, int]]:
    """(first start, windows) of the stretches of overlapping windows around the text's digits and at-signs."""
    runs: list[tuple[int, int]] = []
    last = None
    for m in _TRIGGER.finditer(text):
        s = m.start() // STRIDE * STRIDE
        if s == last:
            continue
        last = s
        if runs and s - STRIDE <= runs[-1][0] + runs[-1][1] * STRIDE:  # its windows join those before
            runs[-1] = (runs[-1][0], (s - runs[-1][0]) // STRIDE + 1)
        else:
            runs.append((s - STRIDE, 2))
    return runs


def _spans(tags: np.ndarray, begin: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of one begin and its insides, or of insides alone, from place begin on."""
    open_: tuple[int, int, int] | None = None
    for k in np.flatnonzero(tags):
        tag, at = int(tags[k]), begin + int(k)
        kind = (tag - 1) // 2
        if open_ and tag % 2 == 0 and kind == open_[1] and at == open_[2]:
            open_ = (open_[0], kind, at + 1)
            continue
        if open_:
            yield open_
        open_ = (at, kind, at + 1)
    if open_:
        yield open_


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger sees in each text. Runs of overlapping windows are decoded as one, those of all texts together."""
    runs = [(j, s, many) for j, text in enumerate(texts) for s, many in _runs_of(text)]
    own = {j: np.concatenate([np.zeros(STRIDE, np.uint8), _encoded(texts[j]), np.zeros(WIDTH + STRIDE, np.uint8)]) for j in {j for j, _, _ in runs}}
    runs.sort(key=lambda r: -r[2])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lo = 0
    while lo < len(runs):
        some = runs[lo : lo + max(1, BATCH // runs[lo][2])]
        lo += len(some)
        lengths = np.array([(many - 1) * STRIDE + WIDTH for _, _, many in some])
        for (j, s, _), tags in zip(some, tagger.decode(_joint(tagger, own, some, int(lengths[0])), lengths), strict=True):
            out[j] += _spans(tags, s)
    return [sorted(spans) for spans in out]


def _whole_runs(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks or space at its ends, then with all of the digits that it begins or ends in."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    while 0 < a < b and text[a] in "0123456789" and text[a - 1] in "0123456789":
        a -= 1
    while a < b < len(text) and text[b - 1] in "0123456789" and text[b] in "0123456789":
        b += 1
    return a, b


def find(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    seen = tag_texts(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, seen, strict=True):
        starts = [a for a, _, _ in own]
        reach = np.maximum.accumulate([b for _, _, b in own]).tolist()  # the furthest end of the spans up to each
        added = []
        for a, kind, b in more:
            a, b = _whole_runs(text, max(a, 0), min(b, len(text)))
            k = bisect_left(starts, b)  # base spans that start before b
            if a < b and _fits(KINDS[kind], text[a:b]) and (k == 0 or reach[k - 1] <= a):
                added.append((a, kind, b))
        out.append((own, sorted(own + added)))
    return out


def detect(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", replace: bool = False) -> DataFrame:
    """docs with base_spans and spans (kind:start:end, comma-joined) and n_<kind> of the base; clashing names are replaced.

    With replace, docs keeps its columns alone and spans in the text become "[EMAIL]" and so on.
    """
    made = [] if replace else ["base_spans", "spans", *(f"n_{k}" for k in KINDS)]
    kept = [f for f in docs.schema if f.name not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {'long' if c[:2] == 'n_' else 'string'}" for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(text_col).to_pylist()
                found = find(tagger, [t or "" for t in texts])
                columns = {f.name: part.column(f.name) for f in kept}
                if replace:
                    columns[text_col] = pa.array([t if t is None else redact(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
                else:
                    columns["base_spans"] = pa.array([written(b) for b, _ in found], pa.string())
                    columns["spans"] = pa.array([written(s) for _, s in found], pa.string())
                    for k, name in enumerate(KINDS):
                        columns[f"n_{name}"] = pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans become the kind's name; of overlapping spans, the joint stretch takes the first one's kind."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
