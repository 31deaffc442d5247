"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text's words (runs of letters, digits and non-ASCII, A-Z lower-cased) enter as a
word vector, known words only, next to the mean vector of the word's character
n-grams (three and six bytes long, the word's ends marked). Windows of ``WINDOW`` words, each half over the next, run through a GRU in
either direction; attention pools the states of a window into one logit; a
document's score is its highest window's, put on a probability scale by a logistic
fit on the training documents. All windows of all whole texts are scored.

Everything is trained in numpy, on the driver, on at most ``max_labels`` labelled
documents of up to ``max_label_bytes`` bytes (documented bounds of the sample: taken
by the order of a hash of doc_id, no class more than half) and at most
``max_windows`` windows of each. Labels say which document is
toxic, not where: training begins at the window with the most telling word and then
follows the window the network itself scores highest. Labels of documents in the
held-out fold (crc32 of doc_id as text, modulo 4, is 2) are never learned from;
lang, source and doc_id are no inputs.

Defined cases: null, empty or wordless text scores 0; repeated rows get equal scores;
null labels and labels without a document are not learned from; without labels of
both classes every score is 0; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import sorted_unique
from .common import LOWER, RangeHash, as_docs, chunks, word_bounds
from .quality import _text_arrays, training_rows

WINDOW, STRIDE = 24, 12
WORD_DIMS, CHAR_DIMS, HIDDEN, CHAR_BITS = 12, 10, 8, 15

# What is no part of a word once A-Z is lower-cased.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[97:123] = False
GAP[128:] = False


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def tokens(data: np.ndarray, offs: np.ndarray):
    """(codes, hashes, n-grams, n-gram bounds, first word of each row): each word's number among
    the distinct words, and of these the hash and the character n-grams, two at each byte, end to end."""
    low = LOWER[data]
    s, e, first = word_bounds(low, offs, GAP)
    codes, hashes = pd.factorize(RangeHash(low).of(s, e))
    at = np.zeros(len(hashes), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    ds, n = s[at], (e - s)[at]
    bounds = np.concatenate([[0], np.cumsum(n)])
    pos = np.repeat(ds - bounds[:-1], n) + np.arange(bounds[-1])
    pad = np.concatenate([low, np.zeros(1, np.uint8)]).astype(np.uint32)
    before, after = pad[pos - 1], pad[pos + 1]
    if len(n):
        before[bounds[:-1]] = 0
        after[bounds[1:] - 1] = 0
    three = (before << np.uint32(16) | pad[pos] << np.uint32(8) | after) + np.uint32(1)
    later = np.zeros(len(three), np.uint32)
    later[:-3] = three[3:]
    left = np.repeat(bounds[1:], n) - np.arange(bounds[-1])  # bytes from here to the word's end
    later[left <= 3] = 0
    six = (three * np.uint32(2654435761)) ^ (later * np.uint32(2246822519)) ^ np.uint32(0x5BD1E995)
    grams = np.stack([three, six], 1).ravel() * np.uint32(2654435761) >> np.uint32(32 - CHAR_BITS)
    return codes, hashes, grams.astype(np.int64), 2 * bounds, first


def window_index(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, rows) of the windows of all rows that have words."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(0, n[row] - WINDOW))
    return first[row] + start, np.minimum(n[row], WINDOW), row


class Net:
    """The parameters, the forward pass and its gradients."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        f, H = np.float32, HIDDEN
        self.vocabulary = np.sort(vocabulary.astype(np.uint64))
        D = WORD_DIMS + CHAR_DIMS
        g = lambda *shape, s=0.3: r.normal(0, s, shape).astype(f)
        self.p = {"word": g(len(vocabulary) + 1, WORD_DIMS), "char": g(1 << CHAR_BITS, CHAR_DIMS), "att": g(2 * H, 2 * H), "att_b": np.zeros(2 * H, f), "att_v": g(2 * H), "out": g(2 * H), "out_b": np.zeros(1, f)}
        for d in "fb":
            self.p |= {f"W{d}": g(D, 3 * H), f"c{d}": np.zeros(3 * H, f), f"U{d}": g(H, 2 * H), f"V{d}": g(H, H)}
        self.slope, self.shift = 1.0, 0.0

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word table; 0 for unknown words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i + 1, 0)

    def inputs(self, known, tri, bounds) -> np.ndarray:
        n = np.diff(bounds)
        if not len(n):
            return np.zeros((0, WORD_DIMS + CHAR_DIMS), np.float32)
        chars = np.add.reduceat(self.p["char"][tri], bounds[:-1], 0) / n[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][known], chars], 1)

    def _run(self, xp, mask, d, keep):
        """States of one direction; xp: (T, B, 3H) projected inputs, mask: (T, B, 1)."""
        T, B, H = len(xp), xp[0].shape[0], HIDDEN
        U, V = self.p[f"U{d}"], self.p[f"V{d}"]
        h, out, cache = np.zeros((B, H), np.float32), [None] * T, []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            x = xp[t]
            zr = _sigmoid(x[:, : 2 * H] + h @ U)
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, 2 * H :] + (r * h) @ V)
            new = h + z * (c - h)
            if mask is not None:
                new = np.where(mask[t], new, h)
            if keep:
                cache.append((t, h, z, r, c))
            h = out[t] = new
        return out, cache

    def forward(self, x: np.ndarray, idx: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; x: inputs of the distinct words, idx: (windows, WINDOW) word numbers."""
        full = bool((length == WINDOW).all())
        mask = None if full else (np.arange(WINDOW)[:, None] < length[None, :])[:, :, None]
        states, caches = [], []
        for d in "fb":
            table = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
            s, c = self._run([table[idx[:, t]] for t in range(WINDOW)], mask, d, keep)
            states.append(s)
            caches.append(c)
        S = np.concatenate([np.stack(states[0]), np.stack(states[1])], 2)  # (T, B, 2H)
        a = np.tanh(S @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"]
        if mask is not None:
            e = np.where(mask[:, :, 0], e, -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * S).sum(0)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return logit, ((S, a, w, pooled, mask, caches) if keep else None)

    def gradients(self, x, idx, length, y):
        logit, (S, a, w, pooled, mask, caches) = self.forward(x, idx, length, True)
        p, H, B = self.p, HIDDEN, len(y)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        dl = ((_sigmoid(logit) - y) / B).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * p["out"]
        dw = (S * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att_v"] = np.tensordot(de, a, ([0, 1], [0, 1]))
        g["att"], g["att_b"] = np.tensordot(S, da, ([0, 1], [0, 1])), da.sum((0, 1))
        dS = w[:, :, None] * dpool + da @ p["att"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U, V = p[f"U{d}"], p[f"V{d}"]
            dh = np.zeros((B, H), np.float32)
            dtable = np.zeros((len(x), 3 * H), np.float32)
            for t, h, z, r, c in reversed(caches[k]):
                dh = dh + dS[t][:, k * H : (k + 1) * H]
                m = 1.0 if mask is None else mask[t]
                dn = dh * m
                dc = dn * z * (1 - c * c)
                drh = dc @ V.T
                dz = dn * (c - h) * z * (1 - z)
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g[f"U{d}"] += h.T @ dzr
                g[f"V{d}"] += (r * h).T @ dc
                np.add.at(dtable, idx[:, t], np.concatenate([dzr, dc], 1))
                dh = dh * (1 - m) + dn * (1 - z) + drh * r + dzr @ U.T
            g[f"c{d}"] = dtable.sum(0)
            g[f"W{d}"] = x.T @ dtable
            dx += dtable @ p[f"W{d}"].T
        return g, dx


def _windows_of(first, codes, start, length):
    """(windows, WINDOW) word numbers; places past a short window's end repeat its last word."""
    i = start[:, None] + np.minimum(np.arange(WINDOW)[None, :], length[:, None] - 1)
    return codes[i]


def train(texts: list[str | None], y: np.ndarray, prior: float | None = None, max_windows: int = 48, steps: int = 600, batch: int = 96, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Net | None:
    """The network from whole labelled texts, or None if a class is missing.

    prior: the share of toxic labels before the sample was balanced. A sixth of the
    documents is kept out of training for the probability scale.
    """
    y = np.asarray(y, float)
    prior = float(y.mean()) if prior is None and len(y) else prior
    if len(y) >= 60:
        turn = np.random.default_rng(seed).permutation(len(y))
        out, rest = turn[: len(y) // 6], np.sort(turn[len(y) // 6 :])
        if len(np.unique(y[out])) == 2 and len(np.unique(y[rest])) == 2:
            net = _fit([texts[i] for i in rest], y[rest], max_windows, steps, batch, rate, decay, seed)
            s = raw_scores(net, *_text_arrays([texts[i] for i in out]))
            _calibrate(net, s, y[out], prior)
            return net
    net = _fit(texts, y, max_windows, steps, batch, rate, decay, seed)
    if net is not None:
        _calibrate(net, raw_scores(net, *_text_arrays(texts)), y, prior)
    return net


def _calibrate(net: Net, s: np.ndarray, y: np.ndarray, prior: float) -> None:
    ok = np.isfinite(s)
    s, y = s[ok], y[ok]
    share = max(1e-6, min(1 - 1e-6, float(y.mean()) if len(y) else prior))
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    net.slope, net.shift = _logistic(s, y, weight)


def _fit(texts, y, max_windows, steps, batch, rate, decay, seed) -> Net | None:
    data, offs = _text_arrays(texts)
    codes, hashes, tri, bounds, first = tokens(data, offs)
    if len(np.unique(y)) < 2 or not len(codes):
        return None
    r = np.random.default_rng(seed)
    # how telling each word is, from the documents that have it
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    once = pd.DataFrame({"w": codes, "r": row}).drop_duplicates()
    df1 = np.bincount(once.w, y[once.r], minlength=len(hashes))
    df = np.bincount(once.w, minlength=len(hashes))
    n1 = max(1.0, y.sum())
    odds = np.log((df1 + 0.5) / n1) - np.log((df - df1 + 0.5) / max(1.0, len(y) - n1))
    # and each character n-gram, which a word shares
    g1, g = np.zeros(1 << CHAR_BITS), np.zeros(1 << CHAR_BITS)
    ow, orow = once.w.to_numpy(), once.r.to_numpy()
    for lo in range(0, len(texts), 100):  # some documents at a time
        i, j = np.searchsorted(orow, lo), np.searchsorted(orow, lo + 100)
        gn = np.diff(bounds)[ow[i:j]]
        gram = tri[np.repeat(bounds[:-1][ow[i:j]] - np.cumsum(gn) + gn, gn) + np.arange(gn.sum())]
        pair = sorted_unique(np.repeat(orow[i:j], gn) << CHAR_BITS | gram)
        g1 += np.bincount(pair & ((1 << CHAR_BITS) - 1), y[pair >> CHAR_BITS], minlength=1 << CHAR_BITS)
        g += np.bincount(pair & ((1 << CHAR_BITS) - 1), minlength=1 << CHAR_BITS)
    godds = np.log((g1 + 0.5) / n1) - np.log((g - g1 + 0.5) / max(1.0, len(y) - n1))
    odds = np.maximum(odds, np.maximum.reduceat(godds[tri], bounds[:-1]))
    frequent = np.flatnonzero(df >= 3)
    net = Net(hashes[frequent[np.argsort(-df[frequent], kind="stable")][:20_000]])
    known = net.known(hashes)
    start, length, wrow = window_index(first)
    tell = odds[_windows_of(first, codes, start, length)].max(1)
    # at most max_windows windows of a document; of toxic ones the most telling first
    frame = pd.DataFrame({"r": wrow, "k": np.where(y[wrow] == 1, -tell, r.random(len(wrow))), "i": np.arange(len(wrow))}).sort_values(["r", "k", "i"])
    keep = np.sort(frame[frame.groupby("r").cumcount() < max_windows].i.to_numpy())
    start, length, wrow, tell = start[keep], length[keep], wrow[keep], tell[keep]
    idx = _windows_of(first, codes, start, length)
    toxic = y[wrow] == 1
    guide = tell.copy()
    neg = np.flatnonzero(~toxic)
    hard = neg
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    size = np.diff(bounds)

    def scored() -> np.ndarray:
        x = net.inputs(known, tri, bounds)
        return np.concatenate([net.forward(x, idx[i : i + 4096], length[i : i + 4096])[0] for i in range(0, len(idx), 4096)])

    def best_of(rows_mask, by):
        w = np.flatnonzero(rows_mask)
        w = w[np.lexsort((-by[w], wrow[w]))]
        return w[np.append(True, wrow[w][1:] != wrow[w][:-1])]

    def leading(by: np.ndarray) -> np.ndarray:
        """The windows of toxic documents near their document's best; labels are not all right, so
        the least telling tenth of the documents is left out."""
        w = best_of(toxic, by)
        w = w[np.argsort(-by[w], kind="stable")][: max(1, int(len(w) * 0.9))]
        most = np.full(len(texts), np.inf)
        most[wrow[w]] = by[w]
        return np.flatnonzero(toxic & (by >= most[wrow] - 1.5))

    pos = leading(guide)
    for t in range(1, steps + 1):
        if t % 150 == 0:
            s = scored()
            pos = leading(guide + s)
            hard = neg[np.argsort(-s[neg], kind="stable")[: max(batch, len(neg) // 20)]]
        take = np.concatenate([r.choice(pos, batch // 2), r.choice(neg, batch // 4), r.choice(hard, batch // 4)])
        # of most toxic windows, words other than the most telling give way to words of clean windows
        some = idx[take].copy()
        half = batch // 2
        telling = odds[some[:half]]
        lose = (telling < telling.max(1, keepdims=True) - 1.0) & (r.random((half, WINDOW)) < r.choice([0.0, 0.5, 0.9], half)[:, None])
        some[:half][lose] = idx[r.choice(neg, int(lose.sum())), r.integers(0, WINDOW, int(lose.sum()))]
        words, local = np.unique(some, return_inverse=True)
        local = local.reshape(len(take), WINDOW)
        pieces = np.repeat(bounds[words] - np.concatenate([[0], np.cumsum(size[words])[:-1]]), size[words]) + np.arange(size[words].sum())
        lb = np.concatenate([[0], np.cumsum(size[words])])
        x = net.inputs(known[words], tri[pieces], lb)
        g, dx = net.gradients(x, local, length[take], toxic[take].astype(np.float32))
        g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
        np.add.at(g["word"], known[words], dx[:, :WORD_DIMS])
        np.add.at(g["char"], tri[pieces], np.repeat(dx[:, WORD_DIMS:] / size[words][:, None].astype(np.float32), size[words], 0))
        for k, v in net.p.items():
            g[k] = g[k] + decay * v
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            v -= (rate * (1 - 0.9 * t / steps) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def _logistic(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift of a lightly held logistic fit by bounded Newton steps."""
    mid, scale = float(np.median(s)), float(s.std()) + 1e-6
    x = (s - mid) / scale
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, w = weight * (p - y), weight * p * (1 - p)
        ga, gb = (d * x).sum() + 0.5 * (a - 1), d.sum() + 0.05 * b
        haa, hab, hbb = (w * x * x).sum() + 0.5, (w * x).sum(), w.sum() + 0.05
        det = haa * hbb - hab * hab
        a -= float(np.clip((hbb * ga - hab * gb) / det, -0.5, 0.5))
        b -= float(np.clip((haa * gb - hab * ga) / det, -0.5, 0.5))
    a = max(a, 0.05) / scale
    return a, b - a * mid


def raw_scores(net: Net, data: np.ndarray, offs: np.ndarray, most: int = 4096) -> np.ndarray:
    """Each row's highest window logit; -inf without words."""
    codes, hashes, tri, bounds, first = tokens(data, offs)
    x = net.inputs(net.known(hashes), tri, bounds)
    start, length, row = window_index(first)
    best = np.full(len(offs) - 1, -np.inf)
    short = length < WINDOW
    for part in (np.flatnonzero(~short), np.flatnonzero(short)):
        for i in range(0, len(part), most):
            w = part[i : i + most]
            logit, _ = net.forward(x, _windows_of(first, codes, start[w], length[w]), length[w])
            np.maximum.at(best, row[w], logit)
    return best


def score_rows(net: Net | None, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each row's score: its highest window's, on the probability scale."""
    out = np.zeros(len(offs) - 1)
    if net is None:
        return out
    best = raw_scores(net, data, offs)
    some = np.isfinite(best)
    out[some] = 1 / (1 + np.exp(-np.clip(net.slope * best[some] + net.shift, -40, 40)))
    return out


def _score_task(shared):
    def run(batches):
        net = shared.value
        for b in batches:
            for at, to, data, offs in chunks(b):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at:to], pa.array(score_rows(net, data, offs), pa.float64())], names=["doc_id", "score"])

    return run


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labels: int = 3000, max_label_bytes: int = 60_000, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    rows = training_rows(docs, labels, "toxic", folds, held, max_labels).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_label_bytes).toArrow()
    order = np.lexsort((rows["y"].to_numpy(), rows["doc_id"].to_numpy())) if len(rows) else []
    texts = rows["text"].to_pylist()
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds
    prior = labels.where("toxic in (0, 1) and doc_id is not null").where(fold != held).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    net = train([texts[i] for i in order], rows["y"].to_numpy()[order].astype(float), prior) if len(rows) else None
    model = spark.sparkContext.broadcast(net)  # at most 20,000 words and 2**CHAR_BITS trigrams
    out = as_docs(docs).mapInArrow(_score_task(model), "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
