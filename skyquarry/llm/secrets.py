r"""Secret scans: base patterns, and a character convolutional network over every other candidate.

A candidate is what base findings leave of a maximal run of [A-Za-z0-9+/_.=-]: each part of 12 or more characters with a
letter that has a digit too, or a capital after a small letter, or LONG characters. The network sees it in windows of BODY
characters with LEFT characters before and RIGHT after; a longer candidate has several windows and its largest score
counts. It learns from labelled findings: all different windows of base findings (secrets) and of candidates (none) of all
documents, in groups of about GROUP by a hash. A first group trains a network, all others go on from it in tasks of their
own, and the networks' mean, weighed by examples, is the model. Each group gets the generated findings too, so that both
kinds always exist. Half of the secrets get another's surroundings, so that the key word before a secret isn't all there is
to learn. Scores are calibrated by a logistic fit on a histogram of all held-out findings. The threshold is the largest, to
a BIN of scores, at which RECALL of held-out secrets is found, wherever that lies.
"""

from __future__ import annotations

import copy
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, limited_batches, ship, table, written

ship(__name__)

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
KEYWORD = re.compile(r"(?ai)passw|secret|token|api_?key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_RUN, LONG = 12, 20
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_LETTER, _DIGIT, _MIXED = re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile("[a-z][A-Z]")
LEAST_VALUE, LEAST_ACCESS = 8, 16
LEFT, BODY, RIGHT = 24, 64, 8
LENGTH = LEFT + BODY + RIGHT
GROUP, GENERATED = 6000, 600
#: Width of the histogram's bins of scores, and the score beyond which all are in the last one.
BIN, FAR = 0.01, 100.0
RECALL = 0.95
EMBED, WIDTH, FILTERS, EPOCHS, BATCH = 8, 5, 24, 5, 64
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"'@ ,\n"
#: 0 is padding, the last two are other ASCII characters and all others.
_ID = {c: i + 1 for i, c in enumerate(_SYMBOLS)}
N_SYMBOLS = len(_SYMBOLS) + 3
_TABLE = np.array([_ID.get(chr(i), N_SYMBOLS - 2) for i in range(128)] + [N_SYMBOLS - 1], np.int16)

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Findings of the three base patterns, by start and then kind. Equal to leftmost non-overlapping matches of each."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in RUN.finditer(text):  # a run of 32 hexadecimal digits lies inside such a run
        if run.end() - run.start() >= 32:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Parts of runs that no base finding overlaps, in order. One walk over the runs and the findings."""
    taken: list[list[int]] = []  # base findings, those that overlap as one
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, k = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        parts, j = [], k
        while j < len(taken) and taken[j][0] < b:
            parts.append((a, taken[j][0]))
            a, j = taken[j][1], j + 1
        k = max(k, j - 1)
        out += [(x, y) for x, y in (*parts, (a, b)) if y - x >= LEAST_RUN and _may_be(text[x:y])]
    return out


def _may_be(s: str) -> bool:
    return bool(_LETTER.search(s)) and (len(s) >= LONG or bool(_DIGIT.search(s)) or bool(_MIXED.search(s)))


def encoded(text: str, a: int, b: int, at: int) -> np.ndarray:
    """The window of a candidate [a, b) whose body begins at `at`."""
    left, body, right = text[max(0, at - LEFT) : at], text[at : min(b, at + BODY)], text[min(b, at + BODY) : min(b, at + BODY) + RIGHT]
    s = left.rjust(LEFT, "\0") + body.ljust(BODY, "\0") + right.ljust(RIGHT, "\0")
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(codes, 128)]
    out[codes == 0] = 0
    return out


class Network:
    """Embedding and a mark for the body, one convolution, maxima and means, one logistic unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n_in = (EMBED + 1) * WIDTH
        self.w = [r.normal(0, 0.3, (N_SYMBOLS, EMBED)), r.normal(0, n_in**-0.5, (n_in, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
        self.w = [x.astype(np.float32) for x in self.w]
        self.scale, self.threshold = (1.0, 0.0), 0.5

    def forward(self, x: np.ndarray):
        e, k, kb, d, db = self.w
        inside = np.zeros((len(x), LENGTH, 1), np.float32)
        inside[:, LEFT : LEFT + BODY, 0] = x[:, LEFT : LEFT + BODY] > 0
        z = np.concatenate([e[x] * (x > 0)[..., None], inside], axis=2)
        cols = np.concatenate([z[:, i : LENGTH - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        h = np.maximum(cols @ k + kb, 0)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return pooled @ d + db[0], (z, cols, h, pooled)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam on the logistic loss."""
        r = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                rows = order[i : i + BATCH]
                grads = self._gradients(x[rows], y[rows])
                t += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.99 * v[j] + 0.01 * g * g
                    self.w[j] -= (0.01 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)

    def _gradients(self, x, y):
        e, k, _, d, _ = self.w
        s, (z, cols, h, pooled) = self.forward(x)
        ds = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(x)).astype(np.float32)
        dp = ds[:, None] * d[None]
        n = h.shape[1]
        dh = np.repeat(dp[:, None, FILTERS:] / n, n, axis=1)
        top = h.argmax(axis=1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
        dh *= h > 0
        dk = cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, FILTERS)
        dc = dh @ k.T
        dz = np.zeros_like(z)
        for i in range(WIDTH):
            dz[:, i : i + n] += dc[:, :, i * (EMBED + 1) : (i + 1) * (EMBED + 1)]
        de = np.zeros_like(e)
        np.add.at(de, x.ravel(), (dz[..., :EMBED] * (x > 0)[..., None]).reshape(-1, EMBED))
        return [de, dk, dh.sum(axis=(0, 1)), pooled.T @ ds, np.array([ds.sum()])]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.calibrate_scores(self.logits(x).astype(float), y, np.ones(len(x)))

    def calibrate_scores(self, s: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Logistic fit of held-out labels on scores, each found n times, then the threshold for RECALL."""
        a, b = 1.0, 0.0
        mean = lambda v: (v * n).sum() / n.sum()
        spread = mean((s - mean(s)) ** 2) ** 0.5
        # smoothed labels keep the fit finite where scores separate the labels
        goal = np.where(y > 0, (n[y > 0].sum() + 1) / (n[y > 0].sum() + 2), 1 / (n[y == 0].sum() + 2))
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            a, b = a - 0.05 * mean((p - goal) * s) / (spread + 1e-6), b - 0.5 * mean(p - goal)
        self.scale = (a, b)
        known = self.probability(s[y > 0])
        order = np.argsort(known, kind="stable")
        upto = n[y > 0][order].cumsum()
        at = np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right") if len(upto) else 0
        self.threshold = float(known[order][at]) if len(upto) else 0.5

    def probability(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * s + self.scale[1], -30, 30)))


def _windows(text: str, a: int, b: int) -> list[np.ndarray]:
    return [encoded(text, a, b, at) for at in range(a, b, BODY)]


def _examples(batches):
    """A row for each base finding and candidate: label, its first window, and a hash to choose by."""
    for df in batches:
        rows = []
        for text in df["text"]:
            if not text:
                continue
            base = base_spans(text)
            for a, kind, b in base:
                if kind == 0:  # the value, not the key word
                    a = ASSIGN.match(text, a).start(2)
                rows.append((1, encoded(text, a, b, a).astype(np.uint8).tobytes()))
            rows += [(0, encoded(text, a, b, a).astype(np.uint8).tobytes()) for a, b in candidates(text, base)]
        yield pd.DataFrame({"label": [r[0] for r in rows], "window": [r[1] for r in rows], "chosen": [zlib.crc32(r[1]) for r in rows]})


def _generated(n: int) -> list[tuple[int, np.ndarray]]:
    """n secrets and n other tokens, made by rule from a fixed seed."""
    r = np.random.default_rng(5)
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    az, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(az, int(r.integers(2, 9)))
    secrets = [
        lambda: pick(num + "abcdef", int(r.choice([32, 40, 64]))), lambda: pick(num + "ABCDEF", int(r.choice([32, 40, 64]))), lambda: "AKIA" + pick(up + num, 16),
        lambda: pick(az + up + num + "+/", 40), lambda: "ghp_" + pick(az + up + num, 36), lambda: pick(az + up + num, int(r.integers(16, 40))), lambda: pick(az + num, int(r.integers(16, 40))),
        lambda: pick(az + up, int(r.integers(16, 40))),
    ]
    others = [
        lambda: f"{word()}.{r.integers(100)}", lambda: f"20{r.integers(10, 30)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}T{r.integers(24):02}", lambda: f"{word()}-{word()}-{r.integers(1000)}", lambda: f"{word()}/{word()}/{r.integers(1000)}.html",
        lambda: f"{word()}_{word()}{r.integers(10)}", lambda: f"v{r.integers(9)}.{r.integers(20)}.{r.integers(20)}-{word()}", lambda: f"mail{r.integers(9)}.example.com", lambda: f"{word()}{word()}{word()}{r.integers(10)}", lambda: f"{r.integers(10**6)}{word()}",
        lambda: "".join(word().capitalize() for _ in range(3)) + "Name", lambda: "-".join(word() for _ in range(6)), lambda: "".join(word() for _ in range(6)).ljust(LONG, "e"), lambda: f"www.{word()}.example.org/{word()}/{word()}",
    ]
    out = []
    for label, makers in ((1, secrets), (0, others)):
        for i in range(n):
            s = makers[i % len(makers)]().ljust(12, "0")
            before = " ".join(word() for _ in range(5)) + " "
            text = f"{before}{s} {word()}"
            out.append((label, encoded(text, len(before), len(before) + len(s), len(before))))
    return out


def train(docs: DataFrame, text: str = "text") -> Network:
    """Learn from findings in all documents. The driver gets one network, its mean with others, and a histogram."""
    spark = docs.sparkSession
    found = limited_batches(docs.select(F.col(text).alias("text"))).mapInPandas(_examples, "label int, window binary, chosen long")
    found = written(found.dropDuplicates(["label", "window"]), "secret-examples")
    groups = max(1, round(found.count() / GROUP))
    # a row without a window for each group, so that none is empty
    rows = found.withColumn("g", F.pmod(F.xxhash64("window"), F.lit(groups)))
    rows = rows.unionByName(spark.range(groups).select(F.lit(-1).alias("label"), F.lit(b"").alias("window"), F.lit(0).cast("long").alias("chosen"), F.col("id").alias("g")))
    rows = written(rows.repartition(min(groups, 4096), "g"), "secret-groups")

    def trained(net):
        def one(df: pd.DataFrame) -> pd.DataFrame:
            own, (x, y, held) = copy.deepcopy(net.value), _prepared(df)
            own.fit(x[~held], y[~held])
            n = float((~held).sum())
            return pd.DataFrame({"piece": range(len(own.w)), "g": df["g"].iloc[0], "n": n, "v": [(w.astype(np.float64) * n).tobytes() for w in own.w]})

        return one

    def scores(net):
        def one(df: pd.DataFrame) -> pd.DataFrame:
            x, y, held = _prepared(df)
            s = np.floor(np.clip(net.value.logits(x[held]), -FAR, FAR) / BIN).astype(np.int64)
            return pd.DataFrame({"label": y[held].astype(int), "bin": s})

        return one

    kind, net = "piece int, g long, n double, v binary", Network()
    spread = lambda df: df.repartition(min(groups, 4096), "g").groupBy("g")
    first = written(spread(rows.filter("g = 0")).applyInPandas(trained(spark.sparkContext.broadcast(net)), kind), "secret-networks")
    net.w = _mean(net, first)
    if groups > 1:
        more = spread(rows.filter("g > 0")).applyInPandas(trained(spark.sparkContext.broadcast(copy.deepcopy(net))), kind)
        net.w = _mean(net, first.unionByName(written(more, "secret-networks")))
    bins = spread(rows).applyInPandas(scores(spark.sparkContext.broadcast(copy.deepcopy(net))), "label int, bin long").groupBy("label", "bin").count().orderBy("label", "bin").collect()
    net.calibrate_scores(np.array([r["bin"] * BIN for r in bins]), np.array([r["label"] for r in bins]), np.array([float(r["count"]) for r in bins]))
    return net


def _prepared(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's examples and the generated ones: windows, labels, and which are held out."""
    df = df[df["label"] >= 0].sort_values(["label", "chosen", "window"], ascending=[False, True, True])
    rows = [(k, np.frombuffer(w, np.uint8).astype(np.int16)) for k, w in zip(df["label"], df["window"])] + _generated(GENERATED)
    x, y = np.stack([r[1] for r in rows]), np.array([r[0] for r in rows], np.float32)
    held = np.array([zlib.crc32(r.tobytes()) % 5 == 0 for r in x])
    r = np.random.default_rng(3)
    # half of the secrets stand in the surroundings of others
    x = x.copy()
    away = np.flatnonzero((y > 0) & (r.random(len(y)) < 0.5))
    x[away, :LEFT] = x[r.choice(np.flatnonzero(y == 0), len(away)), :LEFT]
    return x, y, held


def _mean(net: Network, networks: DataFrame) -> list[np.ndarray]:
    """The mean of networks, piece by piece, in the order of their groups."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("g")
        return pd.DataFrame({"piece": df["piece"].iloc[:1].tolist(), "v": [(sum(np.frombuffer(v, np.float64) for v in df["v"]) / df["n"].sum()).tobytes()]})

    rows = networks.groupBy("piece").applyInPandas(one, "piece int, v binary").collect()
    return [np.frombuffer(r["v"], np.float64).reshape(w.shape).astype(np.float32) for w, r in zip(net.w, sorted(rows, key=lambda r: r["piece"]))]


SPANS = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
FOUND = T.ArrayType(SPANS)


def _scanner(net):
    def scan(text: pd.Series) -> pd.Series:
        spans, windows, owner = [], [], []
        for i, t in enumerate(text):
            base = base_spans(t) if t else []
            spans.append(base)
            for a, b in candidates(t, base) if t else ():
                for w in _windows(t, a, b):
                    windows.append(w)
                    owner.append((i, a, b))
        n = net.value
        if windows:
            for key in {o for o, p in zip(owner, n.probability(n.logits(np.stack(windows)))) if p >= n.threshold}:
                spans[key[0]] = spans[key[0]] + [(key[1], 3, key[2])]
        return pd.Series([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(s)] for s in spans], index=text.index, dtype=object)

    return F.pandas_udf(scan, FOUND)


def scanned(docs: DataFrame, net: Network, text: str = "text", name: str = "spans_") -> DataFrame:
    """docs with an array of spans (start, kind, end in code points) by start and kind. Null and empty texts have none."""
    return limited_batches(docs).withColumn(name, _scanner(docs.sparkSession.sparkContext.broadcast(net))(F.col(text)))


@F.pandas_udf(T.StringType())
def _redact(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, spans):
        if t is None or found is None or not len(found):
            out.append(t)
            continue
        parts, at = [], 0
        for s in found:
            if s["end"] <= at:
                continue
            # overlapping spans become one placeholder
            parts += [t[at : s["start"]], "<secret>"] if s["start"] >= at else []
            at = s["end"]
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out, index=text.index, dtype=object)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each secret in the text replaced by <secret>.

    Null texts stay null, an empty table stays empty, and columns keep their names, whatever these are; equal rows are changed alike.
    Spans that overlap become one <secret>.
    """
    found = scanned(carried(docs, text=text), train(docs, text))
    # only texts with a secret pass through Python again
    plain = F.when(F.size("spans_") > 0, F.col("text"))
    new = F.coalesce(_redact(plain, F.col("spans_")), F.col("text"))
    return found.select("doc_", new.alias("new_")).select(*(F.col("new_").alias(c) if c == text else F.col("doc_")[c].alias(c) for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans from doc_id and spans_."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda k: F.size(F.filter("spans_", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans_", lambda x: x["kind"] != "model"), line), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans_", line), ",").alias("spans"))


def op1_secrets(spark, sf_dir):
    """Null texts count as empty ones. Rows are scanned one by one, so repeated rows give repeated results; texts are read whole.

    Only doc_id and text are read, so other columns may have any names. A candidate at the threshold is a secret. An empty
    table gives an empty result; without base findings nothing is learned and only base spans are returned.
    """
    docs = table(spark, sf_dir, "documents")
    return digests(scanned(docs.select("doc_id", "text"), train(docs)))
