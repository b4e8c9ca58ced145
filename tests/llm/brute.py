"""Plain versions of the operators over lists, written without any of their code."""

import hashlib
import math
import re

import numpy as np

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def utf8(t):
    return (t or "").encode()


def words(t):
    return WORD.findall(utf8(t).lower())


def sha(b):
    return hashlib.sha256(b).hexdigest()


def near(docs):
    """{id: (set size, component)} of (id, text) with distinct ids."""
    sets = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", utf8(t).lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and label[a] < label[b]:
                    label[b], moved = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def contamination(text, items):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of a text against (item_id, text)."""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)


def repeats(docs, length=100):
    """[(n_bytes, n_removed, n_spans, kept bytes)] of (id, text), in the order given; ids distinct."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = utf8(t)
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def licenses(text):
    """(n_words, n_base, first, last, base labels)."""
    w, at = words(text), []
    for label, phrase in (("mit", b"mit license"), ("apache", b"apache license"), ("gpl", b"general public license")):
        p = phrase.split()
        at += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def license_labels(text, templates):
    """(labels, score): runs of near diagonals of shared word grams with enough votes, aligned word by word in order."""
    w, best, labels = words(text), 0.0, set()
    for label, base, t in templates:
        t = words(t)
        k = 2 if len(t) <= 7 else 5
        count = {}
        for p in range(len(t) - k + 1):
            for at in range(len(w) - k + 1):
                if t[p : p + k] == w[at : at + k]:
                    count[at - p] = count.get(at - p, 0) + 1
        runs = []
        for d in sorted(count):
            if runs and d - runs[-1][-1] <= (0 if base else 4):
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            if sum(count[d] for d in run) < (1.0 if base else 0.4) * (len(t) - k + 1):
                continue
            n = end = 0
            for p, x in enumerate(t):
                at = [q for q in range(max(p + run[0], end, 0), min(p + run[-1] + 1, len(w))) if w[q] == x]
                if at:
                    n, end = n + 1, at[0] + 1
            if n / len(t) >= (1.0 if base else 0.75):
                labels.add(label)
                best = max(best, n / len(t))
    return ",".join(sorted(labels)), round(best, 9)


def audio(data):
    """Log-mel frames [n, 40], and (start, end) seconds of the segments, of 8-bit samples at 16 kHz."""
    x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    taps = np.sinc(np.arange(-16, 17) / 2) * np.kaiser(33, 5.0) / 2
    y = np.convolve(x, taps)[16 : 16 + len(x) : 2]  # low pass, then every second sample
    y = np.concatenate([y, np.zeros(max(0, 200 - len(y)))])
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * math.log10(1 + 4000 / 700)
    edges = [hz(top * k / 41) for k in range(42)]
    bank = np.zeros((129, 40))
    for k in range(129):
        f = k * 8000 / 256
        for m in range(40):
            lo, mid, hi = edges[m : m + 3]
            bank[k, m] = max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
    mel, level = [], []
    for at in range(0, len(y) - 199, 80):
        w = y[at : at + 200] * np.hanning(200)
        mel.append(np.log(np.abs(np.fft.rfft(w, 256)) ** 2 @ bank + 1e-6))
        level.append(10 * math.log10((w * w).sum() + 1e-6))
    middle, spans, start = float(np.median(level)), [], None
    for i, e in enumerate([*level, -math.inf]):
        if start is None and e - middle >= 0.5:
            start = i
        elif start is not None and e - middle < -0.5:
            spans.append((round(start * 0.01, 4), round((i - 1) * 0.01 + 0.025, 4)))
            start = None
    return np.array(mel), spans
