"""Secret scans: rules, and a character convolutional network over every candidate and its surroundings.

The network is numpy only: characters are embedded, a convolution runs over a window around the candidate, its maxima over
the candidate and over the context before it feed one hidden layer. It learns from labelled findings of two kinds: those of
the table itself, where what a rule finds is a secret and other candidates are none unless they look like one to the network
already, and those of a seeded generator, for kinds of secrets that no rule knows. It is calibrated on a part that it was
not trained on, and its threshold keeps RECALL of that part's secrets and, as far as that allows, is over its harmless
candidates. What the rules find is scored too, and stays whatever the network says.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialise

#: The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")
#: Other candidates: unbroken runs that are not just words, joined by marks or not: with a digit or with mixed case inside.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
NOT_WORDS = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]")

BEFORE, INSIDE, AFTER = 24, 48, 8
WINDOW = BEFORE + INSIDE + AFTER
EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
#: Generated findings; documents of the table that labelled findings are taken from, by a hash of their text, and findings of
#: either label from there, at most.
TRAINING, TABLE_DOCS, TABLE_FINDINGS = 6000, 20_000, 2000
EPOCHS, SEED = 8, 11
RECALL = 0.98
SYMBOLS = {c: i + 2 for i, c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n")}  # 0: outside, 1: other


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of each finding of the rules what the network looks at: the span, and of an assignment its value."""
    return [ASSIGN.match(text, s).span(2) if kind == 0 else (s, e) for s, kind, e in base]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that touch nothing that a rule has found."""
    taken: list[list[int]] = []  # what the rules have found, joined where it overlaps
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        if NOT_WORDS.search(m[0]):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                out.append(m.span())
    return out


def window(text: str, start: int, end: int) -> list[int]:
    """The candidate's symbols with what stands around it; of a long candidate, INSIDE symbols from start on."""
    before = text[max(0, start - BEFORE) : start]
    inside = text[start : min(end, start + INSIDE)]
    after = text[end : end + AFTER]
    get = SYMBOLS.get
    return [0] * (BEFORE - len(before)) + [get(c, 1) for c in before] + [get(c, 1) for c in inside] + [0] * (INSIDE - len(inside)) + [get(c, 1) for c in after] + [0] * (AFTER - len(after))


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin; together they see all of it."""
    return [*range(start, end - INSIDE, INSIDE), max(start, end - INSIDE)]


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, places = len(x), WINDOW - WIDTH + 1
        e = self.embed[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, places, WIDTH * EMBED)
        conv = np.maximum(cols @ self.conv + self.conv_bias, 0)
        context, inside = conv[:, : BEFORE - 2], conv[:, BEFORE - 2 :]
        at = np.concatenate([context.argmax(1), inside.argmax(1) + BEFORE - 2], axis=1)
        pooled = np.concatenate([context.max(1), inside.max(1), inside.mean(1)], axis=1)
        hidden = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return hidden @ self.out + self.out_bias[0], (x, cols, conv, at, pooled, hidden)

    def backward(self, d: np.ndarray, kept: tuple) -> list[np.ndarray]:
        x, cols, conv, at, pooled, hidden = kept
        n = len(x)
        d_out, d_hidden = hidden.T @ d, np.outer(d, self.out) * (hidden > 0)
        d_pooled = d_hidden @ self.hidden.T
        d_conv = np.zeros_like(conv)
        rows, f = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        np.add.at(d_conv, (rows, at[:, :FILTERS], f), d_pooled[:, :FILTERS])
        np.add.at(d_conv, (rows, at[:, FILTERS:], f), d_pooled[:, FILTERS : 2 * FILTERS])
        d_conv[:, BEFORE - 2 :] += d_pooled[:, None, 2 * FILTERS :] / (conv.shape[1] - BEFORE + 2)
        d_conv *= conv > 0
        flat = d_conv.reshape(-1, FILTERS)
        d_cols = (d_conv @ self.conv.T).reshape(n, -1, WIDTH, EMBED)
        d_e = np.zeros((n, WINDOW, EMBED))
        for w in range(WIDTH):
            d_e[:, w : w + d_cols.shape[1]] += d_cols[:, :, w]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, x.ravel(), d_e.reshape(-1, EMBED))
        return [d_embed, cols.reshape(-1, WIDTH * EMBED).T @ flat, flat.sum(0), pooled.T @ d_hidden, d_hidden.sum(0), d_out, np.array([d.sum()])]

    def light(self) -> Network:
        """The same in single precision, for scans."""
        return replace(self, **{n: getattr(self, n).astype(np.float32) for n in ("embed", "conv", "conv_bias", "hidden", "hidden_bias", "out", "out_bias")})

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        logits = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label) from a seeded generator, half of them secrets."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: pick("etaoinshrdlucmfw", r.randint(2, 9))
    styles = [str, str, str.upper, str.title, lambda w: w + r.choice(["é", "ñ", "äß", ",", "."])]

    def prose() -> str:
        style, mark = r.choice(styles), r.choice(["", "", "", "!!", ",", "###", " |"])
        return " ".join(style(word()) + mark for _ in range(r.randint(0, 5)))

    alnum = string.ascii_letters + string.digits
    secrets = [
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: base64.b64encode(r.randbytes(r.choice((16, 24, 30, 32, 48)))).decode(),
        lambda: pick(alnum, r.randint(18, 44)),
        lambda: r.randbytes(r.choice((10, 16, 20, 32))).hex().upper(),
        lambda: "eyJ" + pick(alnum, r.randint(20, 40)) + "." + pick(alnum, r.randint(20, 40)) + "." + pick(alnum + "_-", 30),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
    ]
    harmless = [
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + "-" + str(r.randint(1, 2030)),
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/{word()}{r.randint(1, 99)}.html",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}",
        lambda: f"www.{word()}{r.randint(1, 9)}.{word()}.example.com",
        lambda: "".join(word().title() for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)),
        lambda: "_".join(word() for _ in range(r.randint(3, 6))) + f"_v{r.randint(1, 20)}",
        lambda: r.choice("xa0=-") * r.randint(16, 40) + str(r.randint(0, 9)) + word(),
        lambda: f"{word()}.{word()}.{word()}{r.randint(1, 99)}.{word()}",
        lambda: "+".join(f"{word()}{r.randint(0, 9)}" for _ in range(r.randint(3, 6))),
        lambda: word() * r.randint(3, 8) + str(r.randint(1, 999)),
        lambda: pick(string.digits, r.randint(12, 19)),
        lambda: r.choice("/_-.").join(word() for _ in range(r.randint(8, 30))) + r.choice(["", f"/{word()}{r.randint(1, 99)}.html"]),
        lambda: f"mail{r.randint(0, 99)}.{word()}.com",
        lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)) + r.choice(["", "", f"/{r.randint(8, 32)}", f".{word()}"]),
        lambda: f"{word()}{r.choice('._')}{word()}.{r.randint(1, 99)}",
        lambda: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}",
        lambda: f"{word()}{word().title()}{word().title()}",
    ]
    lead = ["", "key: ", "token = ", 'secret="', "Authorization: Bearer ", "export KEY=", "password: ", "auth ", "credentials "]
    plain = ["", "see ", "version ", "file ", "http://", "at ", "name: ", "section ", "id "]
    out = []
    for i in range(n):
        label = i % 2
        body = r.choice(secrets if label else harmless)()
        if len(body) < 12:
            body += pick("0123456789" if not label else alnum, 12 - len(body))
        left = prose() + " " + r.choice(lead if label and r.random() < 0.6 else plain)
        text = left + body + r.choice([" ", ".", '"', "\n", "", "!! ", ", ", "### "]) + prose()
        out.append((text, len(left), len(left) + len(body), label))
    return out


def generated(n: int = TRAINING, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rows = [(t, at, e, label) for t, s, e, label in findings(n, seed) for at in window_starts(s, e)]
    return np.array([window(t, s, e) for t, s, e, _ in rows]), np.array([label for *_, label in rows], float)


def trained(x: np.ndarray, y: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """The network, trained with Adam on three quarters of the labelled windows, calibrated on the rest. Takes seconds."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    fit, held = order[: len(x) * 3 // 4], order[len(x) * 3 // 4 :]
    he = lambda *shape: rng.standard_normal(shape) * math.sqrt(2 / shape[0])
    net = Network(rng.standard_normal((len(SYMBOLS) + 2, EMBED)) * 0.3, he(WIDTH * EMBED, FILTERS), np.zeros(FILTERS), he(3 * FILTERS, HIDDEN), np.zeros(HIDDEN), he(HIDDEN, 1)[:, 0], np.zeros(1))
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 64):
            batch = fit[at : at + 64]
            logits, kept = net.forward(x[batch])
            d = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y[batch]) / len(batch)
            step += 1
            for p, g, m, v in zip(net.parameters(), net.backward(d, kept), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # Calibration: a logistic regression on the logit, by Newton steps.
    z = np.concatenate([net.forward(x[held[i : i + 512]])[0] for i in range(0, len(held), 512)])
    design, beta = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        beta -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), design.T @ (p - y[held]) + 0.1 * (beta - [1, 0]))
    net.scale, net.shift = float(beta[0]), float(beta[1])
    p = net.probability(x[held])
    positive = np.sort(p[y[held] == 1])
    bound = float(positive[int(len(positive) * (1 - RECALL))])
    below = p[(y[held] == 0) & (p < bound)]
    net.threshold = min(bound, max(0.5, float(below.max(initial=0)) + 1e-6))
    return net


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows, labels = [], []
        for t in batch.column(0):
            text = t.as_py() or ""
            base = base_spans(text)
            for label, spans in ((1, dict.fromkeys(values(text, base))), (0, candidates(text, base))):
                windows += [window(text, s, e) for s, e in spans]
                labels += [label] * len(spans)
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.list_(pa.int16())), pa.array(labels, pa.int32())], ["window", "label"])


def fitted(docs: DataFrame) -> Network:
    """The network for a table: trained on generated findings, then on these and the table's own, of which at most
    TABLE_FINDINGS of either label from about TABLE_DOCS documents are taken. A candidate that no rule has found counts as
    harmless only if the first network does not take it for a secret."""
    x, y = generated()
    total = docs.count()
    share = min(1.0, TABLE_DOCS / max(1, total))
    picked = docs.select("text") if share == 1 else docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = materialise(picked.mapInArrow(_labelled, "window array<short>, label int"), "labelled-findings")
    found = [[r["window"] for r in rows.filter(F.col("label") == label).limit(TABLE_FINDINGS).collect()] for label in (1, 0)]
    secrets, others = (np.array(w, int).reshape(-1, WINDOW) for w in found)
    if not len(secrets) + len(others):
        return trained(x, y)
    others = others[trained(x, y, epochs=EPOCHS // 2).probability(others) < 0.5]
    return trained(np.concatenate([x, secrets, others]), np.concatenate([y, np.ones(len(secrets)), np.zeros(len(others))]))


def _scanned(net):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = net.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            spans = [(i, s, e, False) for i, t in enumerate(texts) for s, e in candidates(t, base[i])]
            spans += [(i, s, e, True) for i, t in enumerate(texts) for s, e in values(t, base[i])]
            found: list[list[tuple[int, int, int]]] = [list(b) for b in base]
            least: list[float | None] = [None] * len(texts)
            looks = [(k, at) for k, (_, s, e, _) in enumerate(spans) for at in window_starts(s, e)]
            most = np.zeros(len(spans))  # the likeliest window of a candidate counts
            for first in range(0, len(looks), 4096):
                part = looks[first : first + 4096]
                x = np.array([window(texts[spans[k][0]], at, spans[k][2]) for k, at in part])
                np.maximum.at(most, [k for k, _ in part], network.probability(x))
            for (i, s, e, known), p in zip(spans, most.tolist()):
                if known:
                    least[i] = p if least[i] is None else min(least[i], p)
                elif p >= network.threshold:
                    found[i].append((s, 3, e))
            join = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(rows))
            counts = [[sum(k == kind for _, k, _ in b) for b in found] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts[:3]], pa.array([hashlib.sha256(join(b).encode()).hexdigest() for b in base]), pa.array(map(join, found), pa.string()), pa.array(counts[3], pa.int64()), pa.array(least, pa.float64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network", "least_likely_base"],
            )

    return scan


def secret_scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network, least_likely_base.

    A span is kind:start:end in code points, end exclusive; kind network is the method's own, of which there are n_network.
    least_likely_base is the smallest probability that the network gives to a finding of the rules, null without any. net:
    a network to use; else one is fitted to docs. A null text is empty and has no span. Repeated rows stay. Other columns
    are ignored; an empty table gives an empty result. Each text is scanned in whole and alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net or fitted(docs)).light())
    kind = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long, least_likely_base double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned(shared), kind)
