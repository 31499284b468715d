"""LM scoring: a gated recurrent language model with class-factored output, over whole documents.

Corpus statistics: every word's count over all training documents, with one end for each document. The VOCABULARY most
frequent tokens are the network's own; all others are OTHERS tokens to it, by a hash of their last two characters (which
tell much of the language), and the words of such a token share its probability by their counts plus one. The output is
factored: P(token) = P(class | state) P(token | class, state). Tokens in order of frequency fall into CLASSES classes of
about equal sums of roots of counts; logarithms of corpus counts are the fixed part of both factors, to which the network
adds what it learned from the state.

A gated recurrent unit of STATE numbers is trained by truncated backpropagation in numpy, on all training documents
(TRAIN_SHARE is 1; beyond TRAIN_TOKENS it can be one in more). They fall into groups of about GROUP_TOKENS by hash of id and
text. The first group trains a network for EPOCHS; every other group goes on from it in a task
of its own, once over its documents, and the networks' mean, weighed by tokens, is the model. Gradients stop where a window
begins, but the state is carried from window to window, in training and in scoring, and is zero where a document begins
(in training also where a document that is longer than a stream is cut). So a document's score is the log10 likelihood of
all of its tokens, whatever its length.

Words with at least 1/KNOWN of all tokens, of which there can be KNOWN at most, are in a table sent to executors. The other
words of documents are joined with the corpus counts in Spark.
"""

from __future__ import annotations

import copy
import heapq
import math
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop_tables, limited_batches, own_tables, ship, table, with_uid, written

ship(__name__)

HELD, HELD_IS = 7, 2
VOCABULARY, CLASSES, OTHERS, STATE, KNOWN = 4000, 64, 64, 24, 500_000
TRAIN_TOKENS, TRAIN_SHARE, GROUP_TOKENS = 600_000, 1, 600_000
EPOCHS, STREAMS, WINDOW, STEP = 2, 48, 32, 0.006
#: For the groups after the first: streams, and the first step of a smaller course.
MORE_STREAMS, MORE_STEP = 128, 0.004
#: Numbers that a step of Adam changes at a time, so that all it needs of them stays in a core's cache.
BLOCK = 16_384
#: Steps of Adam after which its sums are decayed; till then newer gradients weigh more instead.
DECAY = 64
#: Runs of rows alike that are summed one by one, instead of all together.
LONG_RUNS = 64
#: Pieces in which networks are summed.
PIECES = 16
SCORE_STREAMS, SCORE_WINDOW = 512, 32
#: Tokens that are scored together at least, so that the longest documents of all their batches run beside each other and beside
#: many others, instead of a few alone at the end of each batch.
SCORE_TOKENS = 4_000_000
#: Rows of logits that are made at a time, so that they stay in a core's cache.
ROWS = 512
#: Different words that a task holds while it counts, or twice as many in batches that are not yet put together.
FLUSH = 400_000
END = b""
LN10 = math.log(10)


def split(texts: pa.Array) -> pa.ListArray:
    """The words of texts (binary; null: none), A-Z lower-cased, cut at just the six ASCII spaces, each text's end after them."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    # a space at the end cuts off one more word, which is empty as END is
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(texts, "", " ")))


def different(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different words, and which of them each word is."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _count(batches):
    """Counts of the words in a partition, in training documents and in held-out ones, in pieces of over FLUSH different words."""
    parts: list[tuple[pa.Array, np.ndarray]] = []

    def together():
        if len(parts) > 1:
            words, which = different(pa.concat_arrays([w for w, _ in parts]))
            counts = np.zeros((2, len(words)), np.int64)
            for n, *own in zip(counts, *(c for _, c in parts)):
                np.add.at(n, which, np.concatenate(own))
            parts[:] = [(words, counts)]

    def out():
        ((words, counts),) = parts
        parts.clear()
        return pa.RecordBatch.from_arrays([words, *map(pa.array, counts)], ["word", "c", "held"])

    _keep_memory()
    for df in batches:
        lists = split(pa.array(df["text"], pa.binary()))
        held = np.repeat(np.asarray(df["held"], bool), np.diff(lists.offsets.to_numpy()))
        words, which = different(lists.values)
        c, h = np.bincount(which, minlength=len(words)), np.bincount(which[held], minlength=len(words))
        parts.append((words, np.array([c - h, h])))
        if sum(len(w) for w, _ in parts) > 2 * FLUSH:
            together()
            if len(parts[0][0]) > FLUSH:
                yield out()
    together()
    if parts and len(parts[0][0]):
        yield out()


def _keep_memory() -> None:
    """Freed arrays stay with the process: the C library's bound for handing memory back at once follows the largest block
    that was freed, up to 32 MB, and small windows otherwise get, and clear, the same pages again and again."""
    np.empty(31 << 20, np.uint8)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5  # in this form nothing overflows


class Gru:
    """tokens 0 .. n - 1 in order of falling counts; the last OTHERS stand for other words."""

    def __init__(self, counts: np.ndarray, seed: int = 1):
        n, r = len(counts), np.random.default_rng(seed)
        share = np.sqrt(np.maximum(counts[:-OTHERS], 1)).cumsum()
        # other words are in classes of their own, of eight tokens
        self.cls = np.r_[np.minimum((share - 1e-9) / share[-1] * CLASSES, CLASSES - 1), CLASSES + np.arange(OTHERS) // 8].astype(np.int64)
        kinds = np.unique(self.cls)
        self.cls = np.searchsorted(kinds, self.cls)
        self.first = np.r_[np.flatnonzero(np.r_[True, np.diff(self.cls) > 0]), n]
        log = np.log(np.maximum(counts, 1).astype(np.float64))
        self.log_word = log.astype(np.float32)
        sums = np.log(np.add.reduceat(np.maximum(counts, 1), self.first[:-1]).astype(np.float64))
        self.log_class = sums.astype(np.float32)
        # as shares, whose exponentials need no maximum
        self.share_class = (sums - np.log(np.exp(sums).sum())).astype(np.float32)
        self.share_word = (log - np.repeat(sums, np.diff(self.first))).astype(np.float32)
        self.alone = self.first[:-1][np.diff(self.first) < 2]
        scale = STATE**-0.5
        self.p = {"x": r.normal(0, 0.3, (n, 3 * STATE)), "h": r.normal(0, scale, (STATE, 3 * STATE)), "b": np.zeros(3 * STATE), "c": r.normal(0, 0.1, (STATE, len(kinds))), "cb": np.zeros(len(kinds)), "w": r.normal(0, 0.1, (n, STATE)), "wb": np.zeros(n)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pieces(self) -> list[np.ndarray]:
        """All numbers of the network, in PIECES pieces."""
        return np.array_split(np.concatenate([x.ravel() for x in self.p.values()]).astype(np.float64), PIECES)

    def set_pieces(self, rows: list) -> None:
        """Rows (piece, n, v), v being n times a piece of a network -> their mean becomes the network."""
        n, v = [0.0] * PIECES, [0.0] * PIECES
        for r in sorted(rows, key=lambda r: (r["piece"], r["n"])):
            n[r["piece"]] += r["n"]
            v[r["piece"]] = v[r["piece"]] + np.frombuffer(r["v"], np.float64)
        if not rows or not all(n):
            return  # nothing was learned from
        flat, at = np.concatenate([x / m for x, m in zip(v, n)]), 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def step(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        """State after a token: z keeps the old state, r gates what is proposed from it."""
        s = STATE
        gx = self.p["x"][ids] + self.p["b"]
        gh = h @ self.p["h"][:, : 2 * s]
        zr = _sigmoid(gx[:, : 2 * s] + gh)
        z, r = zr[:, :s], zr[:, s:]
        n = np.tanh(gx[:, 2 * s :] + (r * h) @ self.p["h"][:, 2 * s :])
        return n + z * (h - n)

    def output(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the tokens after the states."""
        n, cls = len(ids), self.cls[ids]
        a = states @ self.p["c"] + (self.p["cb"] + self.log_class)
        a -= a.max(axis=1, keepdims=True)
        out = a[np.arange(n), cls] - np.log(np.exp(a).sum(axis=1))
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(len(self.first)))
        for k in range(len(self.first) - 1):
            b, f = self.first[k], self.first[k + 1]
            rows = order[edges[k] : edges[k + 1]]
            if f - b < 2 or not len(rows):
                continue
            w = states[rows] @ self.p["w"][b:f].T + (self.p["wb"][b:f] + self.log_word[b:f])
            w -= w.max(axis=1, keepdims=True)
            out[rows] += w[np.arange(len(rows)), ids[rows] - b] - np.log(np.exp(w).sum(axis=1))
        return out

    def calm(self) -> bool:
        """Are exponentials of what was learned, added to log shares, far from the ends of single precision?"""
        p, most = self.p, {k: max(x.max(), -x.min()) for k, x in self.p.items() if k in ("w", "wb", "c", "cb")}
        if STATE * max(most["w"], most["c"]) + max(most["wb"], most["cb"]) < 60:
            return True
        return max(np.abs(p["w"]).sum(axis=1).max() + np.abs(p["wb"]).max(), np.abs(p["c"]).sum(axis=0).max() + np.abs(p["cb"]).max()) < 60

    def _output_grads(self, states: np.ndarray, ids: np.ndarray, grads: dict) -> np.ndarray:
        """Adds the gradients of the loss of tokens after states, which end in a one; returns those of the states.

        ids rise, so every class and every token is one run of rows. An output's gradient is its probability, less one for
        the token itself: probabilities stay undivided (and so is the one), the narrower sides of products are divided in their
        place.
        """
        s, p, calm = STATE, self.p, self.calm()
        kind, n = states.dtype, len(ids)
        cls, edges = self.cls[ids], np.searchsorted(ids, self.first).tolist()
        # of products with exponentials, the first parts are gradients of states, the last, by a column of ones, are sums
        c = np.concatenate([p["c"], (p["cb"] + self.share_class)[None]])
        back, gc, ds = np.ascontiguousarray(c.T), np.zeros(c.T.shape, kind), np.empty((n, s + 1), kind)
        back[:, s] = 1
        places = np.arange(ROWS) * c.shape[1]
        for begin in range(0, n, ROWS):
            here, d = states[begin : begin + ROWS], ds[begin : begin + ROWS]
            e = here @ c
            if not calm:
                e -= e.max(axis=1, keepdims=True)
            np.exp(e, out=e)
            np.matmul(e, back, out=d)
            e.ravel()[places[: len(e)] + cls[begin : begin + ROWS]] -= d[:, s]
            gc += e.T @ (here / d[:, s:])
        ds /= ds[:, s:]
        grads["c"] += gc[:, :s].T
        grads["cb"] += gc[:, s]
        w = np.concatenate([p["w"], (p["wb"] + self.share_word)[:, None]], axis=1)
        by = np.concatenate([p["w"], np.ones((len(w), 1), kind)], axis=1)
        gw, dw = np.zeros_like(w), np.zeros((n, s + 1), kind)
        dw[:, s] = 1
        # exponentials of all classes lie one after another: a class's rows, each of as many numbers as the class has tokens
        wide = np.diff(self.first)
        wide[wide < 2] = 0  # the only token of a class is sure
        ends = np.cumsum(wide * np.diff(edges))
        e = np.empty(ends[-1], kind)
        parts = [(b, f, begin, end, e[to - (f - b) * (end - begin) : to].reshape(end - begin, f - b)) for b, f, begin, end, to, m in zip(self.first.tolist(), self.first[1:].tolist(), edges, edges[1:], ends.tolist(), wide.tolist()) if m and begin < end]
        for b, f, begin, end, own in parts:
            np.matmul(states[begin:end], w[b:f].T, out=own)
            if not calm:
                own -= own.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        for b, f, begin, end, own in parts:
            np.matmul(own, by[b:f], out=dw[begin:end])
        at = wide[cls]
        at = np.cumsum(at) - at + ids - self.first[cls]
        if len(self.alone):
            at, here = at[wide[cls] > 0], dw[wide[cls] > 0, s]
        else:
            here = dw[:, s]
        e[at] -= here
        states = states / dw[:, s:]
        for b, f, begin, end, own in parts:
            np.matmul(own.T, states[begin:end], out=gw[b:f])
        dw /= dw[:, s:]
        ds += dw
        grads["w"] += gw[:, :s]
        grads["wb"] += gw[:, s]
        by[self.alone] = 0
        ds = ds[:, :s]
        runs, sizes = runs_of(ids)
        ds -= np.repeat(by[ids[runs], :s] + back[cls[runs], :s], sizes, axis=0)
        return ds

    def train(self, docs: list[np.ndarray], epochs: int = EPOCHS, most: int = STREAMS, step: float = STEP) -> None:
        """Truncated backpropagation: gradients stop at the beginning of a window, states go on. Adam.

        Adam moves a token's numbers when they are read again, by the sum of what the steps since would have moved them (their
        least roots being the mean of these steps'), so a step's work follows the tokens of its window.

        Every token is learned from: documents run in `most` streams, those that are longer than a stream's share in
        several pieces, and streams that have ended are left out.
        """
        total = sum(map(len, docs))
        piece = max(WINDOW, -(-total // most))
        streams = pack([d[i : i + piece] for d in docs for i in range(0, len(d), piece)], most)
        streams.sort(key=lambda s: -sum(map(len, s)))
        lengths = np.array([sum(map(len, s)) for s in streams], np.int64)
        if not total:
            return
        ids, new = np.zeros((lengths[0], len(streams)), np.int64), np.zeros((lengths[0], len(streams)), bool)
        for j, s in enumerate(streams):
            ids[: lengths[j], j] = np.concatenate(s)
            new[np.cumsum([0, *map(len, s[:-1])]), j] = True
        _keep_memory()
        flat = np.concatenate([x.ravel() for x in self.p.values()])
        m, v, g = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
        self.p, grads = self._views(flat), self._views(g)
        spare = np.empty(BLOCK, flat.dtype)
        n_x = self.p["x"].size  # those of tokens come first
        x_p, x_m, x_v, x_g = (x[:n_x].reshape(self.p["x"].shape) for x in (flat, m, v, g))
        sums, seen = np.zeros(2), np.zeros((len(x_p), 2))  # of steps' factors, and of these times the least roots; where tokens are

        def settle(own):
            """Tokens' numbers after all steps that they have not been moved by: without gradients, factors just add up. Returns
            the tokens' m and v."""
            f, by = (sums - seen[own]).T
            least = np.divide(by, f, out=np.zeros_like(f), where=f > 0)
            mb, vb = x_m[own], x_v[own]
            a = np.sqrt(vb)
            a += np.maximum(least, 1e-30).astype(np.float32)[:, None]
            np.divide(mb, a, out=a)
            a *= f.astype(np.float32)[:, None]
            x_p[own] -= a
            seen[own] = sums
            return mb, vb

        t, windows = 0, range(0, int(lengths[0]), WINDOW)
        for _ in range(epochs):
            h = np.zeros((len(streams), STATE), np.float32)
            for i in windows:
                # m and v are ten and a hundred times the means, up to the factors that undo it here and the decay since a was 0
                a = t % DECAY
                if a == 0 and t:
                    settle(slice(None))
                    sums[:], seen[:] = 0, 0
                    m *= np.float32(0.9**DECAY)
                    v *= np.float32(0.99**DECAY)
                t += 1
                k = int((lengths > i).sum())
                here = np.arange(i, min(i + WINDOW, lengths[0]))[:, None] < lengths[:k]
                own = np.flatnonzero(np.bincount(ids[i : i + WINDOW, :k].ravel(), minlength=len(x_p)))
                mb, vb = settle(own)
                h = self._window(ids[i : i + WINDOW, :k], new[i : i + WINDOW, :k], h[:k], grads, here)
                rate = step * (1 - 0.9 * (t - 1) / (epochs * len(windows)))
                share, square = np.float32(0.9**-a / here.sum()), np.float32((0.81 / 0.99) ** a)
                root = math.sqrt(0.01 * 0.99**a / (1 - 0.99**t))
                factor, least = rate * 0.1 * 0.9**a / (1 - 0.9**t) / root, 1e-7 / root
                gb = x_g[own]
                x_g[own] = 0
                gb *= share
                mb += gb
                gb *= gb
                gb *= square
                vb += gb
                x_m[own], x_v[own] = mb, vb
                sums += factor, factor * least
                for at in range(n_x, len(flat), BLOCK):  # in place and in blocks
                    gb, mb, vb, of = (x[at : at + BLOCK] for x in (g, m, v, flat))
                    a = spare[: len(gb)]
                    gb *= share
                    mb += gb
                    gb *= gb
                    gb *= square
                    vb += gb
                    np.sqrt(vb, out=a)
                    a += np.float32(least)
                    np.divide(mb, a, out=a)
                    a *= np.float32(factor)
                    of -= a
                    gb.fill(0)
        settle(slice(None))

    def _views(self, flat: np.ndarray) -> dict:
        """The arrays of the network as parts of one."""
        at = np.cumsum([0, *(x.size for x in self.p.values())]).tolist()
        return {k: flat[b:e].reshape(x.shape) for (k, x), b, e in zip(self.p.items(), at, at[1:])}

    def _window(self, ids, new, h, grads, here=None):
        """here: which places hold a token; others, after a stream's end, add nothing."""
        s, p, (n_steps, n) = STATE, self.p, ids.shape
        kind = p["x"].dtype
        # what tokens add to gates and proposals, of different tokens first; these apart, so that a step's numbers lie together
        tokens = np.flatnonzero(np.bincount(ids.ravel(), minlength=len(p["x"])))
        places = np.empty(len(p["x"]), np.int64)
        places[tokens] = np.arange(len(tokens))
        places = places[ids]
        table = p["x"][tokens]
        table += p["b"]
        table[:, : 2 * s] *= 0.5  # a sigmoid is half of a tanh of half, and a half
        table = np.ascontiguousarray(table.reshape(-1, 3, s).transpose(1, 0, 2)).reshape(-1, s)
        gx = np.take(table, places[:, None] + np.arange(2)[:, None] * len(tokens), axis=0, mode="clip")
        nx = np.take(table, places + 2 * len(tokens), axis=0, mode="clip")
        zr_w, n_w = np.ascontiguousarray(p["h"][:, : 2 * s].reshape(s, 2, s).transpose(1, 0, 2)) * kind.type(0.5), np.ascontiguousarray(p["h"][:, 2 * s :])
        # states with a one at their end; gates, gated states, proposals; states and the one after the last
        states, zr, (rh, prop), old = np.ones((n_steps, n, s + 1), kind), np.empty((n_steps, 2, n, s), kind), np.empty((2, n_steps, n, s), kind), np.empty((n_steps + 1, n, s), kind)
        begins, z = new.any(axis=1).tolist(), zr[:, 0]
        old[0] = h
        for t, (h, after, own, a, g, b, o) in enumerate(zip(old, old[1:], gx, zr, rh, nx, prop)):
            if begins[t]:
                h[new[t]] = 0
            np.matmul(h, zr_w, out=a)
            a += own
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            np.multiply(a[1], h, out=g)
            np.matmul(g, n_w, out=o)
            o += b
            np.tanh(o, out=o)
            np.subtract(h, o, out=after)
            after *= a[0]
            after += o
        h, old = old[-1], old[:-1]
        states[..., :s] = old
        at = np.arange(ids.size) if here is None else np.flatnonzero(here.ravel())
        x = ids.ravel()[at]
        order = rising(x, len(p["x"]))
        x, order = x[order], at[order]
        ds = np.zeros((ids.size, s), kind)
        ds[order] = self._output_grads(states.reshape(-1, s + 1).take(order, axis=0), x, grads)
        ds = ds.reshape(n_steps, n, s)
        rest, by_n, by_z = 1 - zr, prop * prop, old - prop
        np.subtract(1, by_n, out=by_n)
        by_n *= rest[:, 0]
        by_z *= z
        by_z *= rest[:, 0]
        by_r = rh * rest[:, 1]
        dg, dh = np.empty((n_steps, n, 3 * s), kind), np.zeros((n, s), kind)
        zr_w, n_w = np.ascontiguousarray(p["h"][:, : 2 * s].T), np.ascontiguousarray(n_w.T)
        for t, d, a, bz, br, bn, o in zip(range(n_steps - 1, -1, -1), dg[::-1], zr[::-1], by_z[::-1], by_r[::-1], by_n[::-1], ds[::-1]):
            np.multiply(dh, bz, out=d[:, :s])
            bn *= dh
            d[:, 2 * s :] = bn
            drh = bn @ n_w
            np.multiply(drh, br, out=d[:, s : 2 * s])
            dh *= a[0]
            drh *= a[1]
            dh += drh
            dh += d[:, : 2 * s] @ zr_w
            dh += o
            if begins[t]:
                dh[new[t]] = 0  # a document's first state is a constant
        dg = dg.reshape(-1, 3 * s)
        grads["h"][:, : 2 * s] += old.reshape(-1, s).T @ dg[:, : 2 * s]
        grads["h"][:, 2 * s :] += rh.reshape(-1, s).T @ dg[:, 2 * s :]
        # one sum for each different token
        begin, sizes = runs_of(x)
        by = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[by], sizes[by]
        sums = summed(dg, order, begin, sizes)
        grads["x"][x[begin]] += sums
        grads["b"] += sums.sum(axis=0)
        return h

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each document, the end included."""
        total = np.zeros(len(docs))
        owner = pack(docs, SCORE_STREAMS, places=True)
        if not owner:
            return total
        owner.sort(key=lambda own: -sum(len(docs[i]) for i in own))  # streams that still run come first
        flat = np.concatenate([docs[i] for own in owner for i in own])
        which = np.repeat(np.array([i for own in owner for i in own], np.int32), [len(docs[i]) for own in owner for i in own])
        lengths = np.array([sum(len(docs[i]) for i in own) for own in owner])
        begins = np.cumsum(lengths) - lengths
        _keep_memory()
        s, ready = STATE, self.ready()
        gate_x, n_x, gate_w, n_w = ready["gate_x"], ready["n_x"], ready["gates"], ready["n"]
        h, last = np.zeros((len(owner), s), np.float32), np.full(len(owner), -1)
        for begin in range(0, int(lengths[0]), SCORE_WINDOW):
            k = int((lengths > begin).sum())
            at = begin + np.arange(min(SCORE_WINDOW, int(lengths[0]) - begin))[:, None]
            here = at < lengths[:k]
            at = np.minimum(begins[:k] + at, len(flat) - 1)
            x, o, run = flat[at], which[at], here.sum(axis=1).tolist()
            new = o != np.concatenate([last[None, :k], o[:-1]])
            last[:k] = o[-1]  # those of streams that end here are not read again
            begun, both = new.any(axis=1).tolist(), x[:, None] + np.array([[0], [len(n_x)]])
            states, pos = np.ones((sum(run), s + 1), np.float32), 0
            for t, k in enumerate(run):
                old = h[:k]
                if begun[t]:
                    old[new[t, :k]] = 0
                states[pos : pos + k, :s] = old
                pos += k
                a = np.matmul(old, gate_w)  # first halves of sums, then twice the gates
                a += gate_x.take(both[t, :, :k], axis=0, mode="clip")
                np.tanh(a, out=a)
                a += 1
                z, r = a
                r *= old
                n = r @ n_w
                n += n_x.take(x[t, :k], axis=0, mode="clip")
                np.tanh(n, out=n)
                z *= 0.5
                old -= n
                old *= z
                old += n
            total += np.bincount(o[here], self.log_p(states, x[here], ready), len(docs))
        return total

    def ready(self) -> dict:
        """The network's numbers as scoring needs them: sums that hold for every token are done once, and the fixed parts of
        the output are log shares, so that exponentials of them need no maximum (calm, where what was learned is small)."""
        s, p = STATE, self.p
        table = p["x"] + p["b"]
        table[:, : 2 * s] *= 0.5  # a sigmoid is half of a tanh of half, and a half
        z_x, r_x, n_x = (np.ascontiguousarray(table[:, i : i + s]) for i in (0, s, 2 * s))
        z, r, n = (p["h"][:, i : i + s] * np.float32(0.5) for i in (0, s, 2 * s))
        words = [np.ascontiguousarray(np.concatenate([p["w"][b:f], (p["wb"] + self.share_word)[b:f, None]], axis=1).T) for b, f in zip(self.first, self.first[1:])]
        return {"gate_x": np.concatenate([z_x, r_x]), "n_x": n_x, "gates": np.stack([z, r]), "n": n, "classes": np.concatenate([p["c"], (p["cb"] + self.share_class)[None]]).astype(np.float32), "words": words, "ones": np.ones(len(self.cls), np.float32), "calm": self.calm()}

    def log_p(self, states: np.ndarray, ids: np.ndarray, ready: dict) -> np.ndarray:
        """output() without gradients; states end in a one."""
        if not ready["calm"]:
            return self.output(states[:, :-1], ids)
        n, ones, rows = len(ids), ready["ones"], np.arange(len(ids))
        order = rising(ids, len(self.cls))
        states, ids = states.take(order, axis=0), ids[order]
        cls, edges = self.cls[ids], np.searchsorted(ids, self.first).tolist()
        at, own, total, sums = ids - self.first[cls], np.zeros(n, np.float32), np.empty(n, np.float32), np.ones(n, np.float32)
        for begin in range(0, n, ROWS):  # what stays in a core's cache
            here = slice(begin, begin + ROWS)
            a = states[here] @ ready["classes"]
            own[here] = a[rows[: len(a)], cls[here]]
            np.exp(a, out=a)
            np.matmul(a, ones[: a.shape[1]], out=total[here])
        for w, begin, end in zip(ready["words"], edges, edges[1:]):
            if w.shape[1] < 2 or begin == end:
                continue
            a = states[begin:end] @ w
            own[begin:end] += a[rows[: end - begin], at[begin:end]]
            np.exp(a, out=a)
            np.matmul(a, ones[: a.shape[1]], out=sums[begin:end])
        out = np.empty(n)
        out[order] = own - np.log(total) - np.log(sums)
        return out


def runs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal tokens begin, and their lengths."""
    begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return begin, np.diff(np.r_[begin, len(ids)])


def summed(rows: np.ndarray, order: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs, the longest first, of rows in an order: all first rows, then all second ones and so on; what the long runs
    still have, run by run."""
    out, k = rows.take(order[begin], axis=0), 1
    while (n := int(np.searchsorted(-sizes, -k))) > LONG_RUNS:  # runs that have more than k rows
        out[:n] += rows.take(order[begin[:n] + k], axis=0)
        k += 1
    ones = np.ones(sizes[0], rows.dtype)
    for i, b, m in zip(range(n), (begin[:n] + k).tolist(), (sizes[:n] - k).tolist()):
        out[i] += ones[:m] @ rows.take(order[b : b + m], axis=0)
    return out


def rising(ids: np.ndarray, n: int) -> np.ndarray:
    """The order of tokens below n; small numbers are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if n <= 2**16 else ids, kind="stable")


def pack(docs: list[np.ndarray], streams: int, places: bool = False) -> list:
    """Documents dealt to streams of about equal length, the longest first."""
    heap = [(0, j) for j in range(min(streams, len(docs)))]
    out: list[list] = [[] for _ in heap]
    for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        n, j = heapq.heappop(heap)
        out[j].append(i if places else docs[i])
        heapq.heappush(heap, (n + len(docs[i]), j))
    return out


def pooled(batches):
    """Batches with ids in lists of SCORE_TOKENS tokens or a batch more; the last list may have fewer."""
    own, n = [], 0
    for b in batches:
        own.append(b)
        n += (pc.sum(pc.binary_length(b.column("ids"))).as_py() or 0) // 4
        if n >= SCORE_TOKENS:
            yield own
            own, n = [], 0
    if own:
        yield own


def group(word: bytes) -> int:
    return zlib.crc32(word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")) % OTHERS


def group_col(word):
    return F.crc32(F.right(word, F.lit(2)).cast("binary")) % OTHERS


class Scorer:
    """known: the table's words with counts, the most frequent first, END among them. n, v: tokens, different ones.

    others: for each group of words, tokens and different ones in the whole corpus.
    """

    def __init__(self, known: list[tuple[bytes, int]], n: int, v: int, others: list[tuple[int, int]]):
        self.place = {w: i for i, (w, _) in enumerate(known)}
        self.counted = np.array([c > 0 for _, c in known])
        self.n, self.v, self.own = n, v, min(VOCABULARY, len(known))
        c = np.array([c for _, c in known], np.int64)
        groups = np.array([group(w) for w, _ in known], np.int64)
        mine = groups[: self.own]
        self.other_n = np.array([a for a, _ in others]) - np.bincount(mine, c[: self.own], OTHERS).astype(np.int64)
        #: What a count plus one is divided by in each group.
        self.shared = self.other_n + np.array([b for _, b in others]) - np.bincount(mine, c[: self.own] > 0, OTHERS).astype(np.int64) + 1
        self.base = np.log10((c + 1) / (n + v + 1))
        self.other = np.where(np.arange(len(c)) < self.own, 0.0, np.log10((c + 1) / self.shared[groups]))
        self.id = np.where(np.arange(len(c)) < self.own, np.arange(len(c)), self.own + groups)
        self.net = Gru(np.r_[c[: self.own], np.maximum(self.other_n, 1)])

    def coded(self, texts: pa.Array) -> dict:
        """Columns of a batch of texts: the network's tokens, sums over the table's words, and the words that the table lacks
        with how often each document has them. Each different word is looked up once."""
        _keep_memory()
        lists = split(texts)
        edges, n = lists.offsets.to_numpy(), len(texts)
        words, which = different(lists.values)
        sizes, of = np.diff(edges), np.repeat(np.arange(n), np.diff(edges))
        listed = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.place.get, listed, repeat(-1)), np.int64, len(listed))
        lacks = places < 0
        ids = np.where(lacks, 0, self.id[places]).astype(np.int32)
        ends, end = different(pc.utf8_slice_codeunits(words.filter(pa.array(lacks)), -2))
        ids[lacks] = np.array([self.own + group(w) for w in ends.cast(pa.binary()).to_pylist()], np.int32)[end]
        ids = ids[which]
        in_table = lambda values: np.add.reduceat(np.where(lacks, 0, values[places])[which], edges[:-1]) if n else np.zeros(0)
        at = lacks[which]
        pairs, times = np.unique(of[at] * max(1, len(listed)) + which[at], return_counts=True)
        doc, word = np.divmod(pairs, max(1, len(listed)))
        return {
            "ids": [ids[b:e].tobytes() for b, e in zip(edges.tolist(), edges[1:].tolist())], "n_tokens": pa.array(sizes.astype(np.int64)),
            "n_known": pa.array(in_table(self.counted).astype(np.int64)), "base": pa.array(in_table(self.base)), "other": pa.array(in_table(self.other)),
            "others": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(times, pa.int32())], ["word", "m"])),
        }


def word_counts(docs: DataFrame) -> DataFrame:
    """(text, held) -> (word, c, held): all words, by how often they are in training documents and in others; '' is the end."""
    rows = limited_batches(docs.select(F.col("text").cast("binary").alias("text"), "held"))

    def part(batches):
        yield from _count({"text": b.column("text"), "held": b.column("held").to_pylist()} for b in batches)

    return rows.mapInArrow(part, "word string, c long, held long").repartition("word").groupBy("word").agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


def often(c, n, held, n_held):
    """Has a word 1/KNOWN of the tokens of training, or of the others? So there are 2 * KNOWN such words at most."""
    return (c * KNOWN >= n) & (c > 0) | (held * KNOWN >= n_held) & (held > 0)


def fitted(counts: DataFrame) -> tuple[Scorer, DataFrame]:
    """The table of frequent words and a network, both of bounded size; and the counts of all other words."""
    known_here = F.count_if(F.col("c") > 0)
    ends = F.max(F.when(F.col("word") == "", F.col("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum("held"), F.lit(0)).alias("h"), known_here.alias("v"), ends.alias("ends")).first()
    table_has = often(F.col("c"), total["n"], F.col("held"), total["h"]) | (F.col("word") == "")
    rare = counts.filter(~table_has).select("word", "c")
    if not total["n"]:
        return Scorer([(END, 0)], 0, 0, [(0, 0)] * OTHERS), rare
    known = sorted(((r["word"].encode("utf-8", "surrogatepass"), r["c"]) for r in counts.filter(table_has).select("word", "c").collect()), key=lambda r: (-r[1], r[0]))
    by_group = {r["g"]: (r["n"], r["v"]) for r in counts.groupBy(group_col(F.col("word")).alias("g")).agg(F.sum("c").alias("n"), known_here.alias("v")).collect()}
    others = [by_group.get(g, (0, 0)) for g in range(OTHERS)]
    if (i := next(i for i, r in enumerate(known) if r[0] == END)) >= VOCABULARY:  # the end is always the network's own
        known.insert(VOCABULARY - 1, known.pop(i))
    return Scorer(known, total["n"], total["v"], others), rare


def tokens(docs: DataFrame, scorer: Scorer) -> tuple[DataFrame, int]:
    """(doc_id, text as binary, held) -> every row's columns of Scorer.coded(), and how many groups there are to train on.

    g is the group, of rows that are trained on; ids has their tokens, rest those of all other rows. Rows alike in id and
    text are learned from as often as they are there, the repeats of a partition in other groups.
    """
    wanted = min(scorer.n, TRAIN_TOKENS) + max(0, scorer.n - TRAIN_TOKENS) / TRAIN_SHARE
    groups = max(1, round(wanted / GROUP_TOKENS))
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def part(batches):
        seen: dict[int, int] = {}
        for b in batches:
            to: list[int | None] = []
            for h, learn in zip(b.column("h").to_pylist(), b.column("learn").to_pylist()):
                if not learn:
                    to.append(None)
                    continue
                k = seen[h] = seen.get(h, -1) + 1
                to.append(zlib.crc32(b"%d %d" % (h, k)) % groups)
            out = sent.value.coded(b.column("text"))
            ids = out.pop("ids")
            mine, rest = ([x if (g is None) == other else None for g, x in zip(to, ids)] for other in (False, True))
            own = {"uid": b.column("uid"), "doc_id": b.column("doc_id"), "g": pa.array(to, pa.int32()), "h": b.column("h"), "ids": pa.array(mine, pa.binary()), "rest": pa.array(rest, pa.binary())}
            yield pa.RecordBatch.from_pydict(own | out)

    h = F.xxhash64("doc_id", "text")
    learn = ~F.col("held") & (F.pmod(h, F.lit(1_000_000)) < F.lit(1_000_000 * wanted / max(scorer.n, 1)))
    rows = limited_batches(with_uid(docs.select("doc_id", "text", h.alias("h"), learn.alias("learn"))))
    kind = f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, g int, h long, ids binary, rest binary, n_tokens long, n_known long, base double, other double, others array<struct<word: string, m: int>>"
    return written(rows.mapInArrow(part, kind), "lm-train"), groups


def learned(rows: DataFrame, groups: int, scorer: Scorer) -> None:
    """Train the scorer's network on groups of documents in executors; the driver sees one network's numbers at a time.

    The outcome depends on how the corpus is cut into files, by rounding only where no rows are alike.
    """
    spark = rows.sparkSession
    rows = rows.select("g", "h", "ids")

    def trained(net, epochs, streams, step):
        def part(batches):
            n, sums = 0.0, None
            for docs in grouped(batches):
                own, m = copy.deepcopy(net.value), float(sum(map(len, docs)))
                own.train(docs, epochs, streams, step)
                n, add = n + m, [x * m for x in own.pieces()]
                sums = add if sums is None else [x + y for x, y in zip(sums, add)]
            if sums:
                yield pd.DataFrame({"piece": range(PIECES), "n": n, "v": [x.tobytes() for x in sums]})

        return part

    def train(rows, *how):
        """A group's rows are in one task, one after another; a task's networks leave it as one sum."""
        rows = limited_batches(rows.repartition("g").sortWithinPartitions("g", "h"))
        return rows.mapInPandas(trained(spark.sparkContext.broadcast(net), *how), kind)

    kind, net = "piece int, n double, v binary", scorer.net
    first = train(rows.filter("g = 0"), EPOCHS, STREAMS, STEP).collect()
    net.set_pieces(first)
    if groups > 1:
        with own_tables() as own:
            more = written(train(rows.filter("g > 0"), 1, MORE_STREAMS, MORE_STEP), "lm-networks")
        sums = more.coalesce(64).mapInPandas(_summed, kind).repartition(PIECES, "piece").mapInPandas(_summed, kind)
        net.set_pieces([*first, *sums.collect()])
        drop_tables(spark, own)


def grouped(batches):
    """Rows in the order of g -> the documents of one g after another."""
    last, docs = None, []
    for df in batches:
        for g, x in zip(df["g"].tolist(), df["ids"]):
            if docs and g != last:
                yield docs
                docs = []
            last = g
            docs.append(np.frombuffer(x, np.int32).astype(np.int64))
    if docs:
        yield docs


def _summed(batches):
    """Sums of networks, held one piece each."""
    n: dict[int, float] = {}
    v: dict[int, np.ndarray] = {}
    for df in batches:
        for piece, m, x in zip(df["piece"], df["n"], df["v"]):
            n[piece] = n.get(piece, 0.0) + m
            v[piece] = v.get(piece, 0.0) + np.frombuffer(x, np.float64)
    yield pd.DataFrame({"piece": list(n), "n": list(n.values()), "v": [x.tobytes() for x in v.values()]})


def scored(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    Null and empty texts are one token, the end. Null ids are not held out, and learned from. Without training documents
    every token is unknown: base_score is 0 and so is score's share of other words. Repeated rows are scored alike and all
    counted; texts are scored whole, however long. Of words as frequent, those smaller in bytes come first in the table. Only id
    and text are read, so other columns may have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col("doc_id"), HELD) == HELD_IS, F.lit(False))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    counts = written(word_counts(rows.select("text", held.alias("held"))), "lm-counts")
    rows = rows.withColumn("text", F.col("text").cast("binary"))
    scorer, rare = fitted(counts)
    coded, groups = tokens(rows.withColumn("held", held), scorer)
    if scorer.n:
        learned(coded, groups, scorer)
    sent = spark.sparkContext.broadcast(scorer.net)

    def part(batches):
        for some in pooled(batches):
            by_net, at = sent.value.score([np.frombuffer(x, np.int32) for b in some for x in b.column("ids").to_pylist()]) / LN10, 0
            for b in some:
                own = {k: b.column(k) for k in ("uid", "doc_id", "n_tokens", "n_known", "base")}
                yield pa.RecordBatch.from_pydict(own | {"score": pa.array(b.column("other").to_numpy() + by_net[at : at + len(b)])})
                at += len(b)

    parts = limited_batches(coded.select("uid", "doc_id", "n_tokens", "n_known", "base", "other", F.coalesce("ids", "rest").alias("ids")))
    kind = f"uid long, doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, n_known long, base double, score double"
    done = written(parts.mapInArrow(part, kind), "lm-parts")
    n, v = scorer.n, scorer.v
    # one row for each different word of a document; no word here has more than 1/KNOWN of the tokens
    words = coded.select("uid", F.inline("others"))
    shared = F.element_at(F.array(*(F.lit(float(x)) for x in scorer.shared.tolist())), (group_col(F.col("word")) + 1).cast("int"))
    rare = rare.select("word", (F.col("c") > 0).alias("known"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("b"), F.log10((F.col("c") + 1) / shared).alias("s"))
    words, m = words.join(rare.hint("shuffle_hash"), "word"), F.col("m")
    sums = words.groupBy("uid").agg(F.sum(F.when(F.col("known"), m)).alias("k"), F.sum(m * F.col("b")).alias("b"), F.sum(m * F.col("s")).alias("s"))
    out = done.join(sums, "uid", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("b", zero), 6).alias("base_score"), F.round(F.col("score") + F.coalesce("s", zero), 6).alias("score"),
    )


def op3_lm_score(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
