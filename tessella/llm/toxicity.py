"""Toxicity by a linear-chain conditional random field over words, with two states (toxic, other).

Token labels for training follow from document labels: word forms and word beginnings that occur in far more toxic
documents of the sample than chance allows, and hardly in its clean ones (copies count once), mark the words of toxic
documents as toxic tokens. The field has hashed features of word forms, beginnings and ends, and
transitions; it is fitted by Adam on the whole sample. Forward-backward marginals of every word of a document become its
score (a logistic function of the greatest marginal and of their sum) and the offsets of offending words.

The fit uses a bounded sample of labelled rows (`toxic_rows` and `clean_rows`), drawn by a hash of doc_id; scoring covers
whole texts of all rows.

Defined results: a null or empty text has the score of a document without words; without labelled rows of both kinds all
scores are 0; rows of labels without a value are ignored, a document labelled twice is toxic if any label says so;
repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import chunks, table, text_or_empty, unused

HASH = 1 << 18
LANES = 1024
#: Words kept in a worker's table before it starts anew.
TABLE = 120_000
STRIP = "\"'.,;:!?()[]{}<>*#-_=+/\\|~`$%&^@"


def forms(word: str) -> list[str]:
    """What a word may be recognised by: itself and its beginnings."""
    w = word.lower().strip(STRIP)
    return [f"={w}", *(f"{n}^{w[:n]}" for n in (4, 5, 6) if len(w) >= n)] if w else []


def features(word: str) -> list[int]:
    w = word.lower().strip(STRIP)
    names = (f"={w}", f"3^{w[:3]}", f"4^{w[:4]}", f"5^{w[:5]}", f"6^{w[:6]}", f"3${w[-3:]}", f"#{min(len(w), 12)}", "1")
    return [zlib.crc32(x.encode()) % HASH for x in names]


def _scan(e: np.ndarray, first: np.ndarray, a: np.ndarray, c: float) -> np.ndarray:
    """Odds x[t] = e[t] (a11 x[t-1] + a01) / (a10 x[t-1] + a00), and e[t] c where first[t]; all lanes step together.

    Lanes are equal runs of the flat sequence. A first pass multiplies the steps of each lane to one 2 x 2 map, which
    gives the odds at its start exactly; a second pass fills the lane in."""
    n = len(e)
    steps = -(-n // LANES)
    lanes = -(-n // steps)
    pad = lanes * steps - n
    e = np.append(e, np.ones(pad)).reshape(lanes, steps).T.copy()
    first = np.append(first, np.zeros(pad, bool)).reshape(lanes, steps).T.copy()
    (a00, a01), (a10, a11) = a
    p, q, r, s = (np.full(lanes, v) for v in (1.0, 0.0, 0.0, 1.0))
    for t in range(steps):
        x, f = e[t], first[t]
        p, r = x * (a11 * p + a01 * r), a10 * p + a00 * r
        q, s = x * (a11 * q + a01 * s), a10 * q + a00 * s
        if f.any():
            p[f], r[f], q[f], s[f] = 0, 0, x[f] * c, 1
        scale = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    start = np.empty(lanes)
    at = c
    for k, (p1, q1, r1, s1) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        start[k] = at
        at = (p1 * at + q1) / (r1 * at + s1)
    out, x = np.empty((steps, lanes)), start
    for t in range(steps):
        x = e[t] * (a11 * x + a01) / (a10 * x + a00)
        if first[t].any():
            x = np.where(first[t], e[t] * c, x)
        out[t] = x
    return out.T.ravel()[:n]


def marginals(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the probability of the toxic state, and forward odds; emit: log odds of the words of documents that have sizes words."""
    n = len(emit)
    if not n:
        return np.empty(0), np.empty(0)
    e = np.exp(np.clip(emit, -30, 30))
    t = np.exp(trans)
    ends = np.cumsum(sizes[sizes > 0])
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[np.append(0, ends[:-1])] = True
    last[ends - 1] = True
    forward = _scan(e, first, t, 1.0)
    # backward: u[t] = e[t] b[t], b[t] = (t10 + t11 u[t+1]) / (t00 + t01 u[t+1]), 1 at the end
    u = _scan(e[::-1], last[::-1], t.T, 1.0)[::-1]
    odds = forward * (u / e)
    return odds / (1 + odds), forward


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    scale: np.ndarray  # of the logistic function: constant, greatest marginal's log odds, log of the sum

    def emissions(self, words: list[str]) -> np.ndarray:
        return self.weights[np.array([features(w) for w in words], dtype=np.int64).reshape(-1, 8)].sum(axis=1)


def one_of_each(texts: list[str]) -> list[int]:
    """Positions of texts that share no least shingle hash with an earlier one: copies of a text count once as evidence."""
    seen: list[set[int]] = [set() for _ in range(4)]
    out = []
    for k, t in enumerate(texts):
        w = t.split()
        h = np.array([zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))], dtype=np.uint64)
        least = [int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
        if not any(x in s for x, s in zip(least, seen, strict=True)):
            out.append(k)
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return out


def token_forms(words: list[str], docs: list[np.ndarray], toxic: np.ndarray, ratio: float = 20, chance: float = 1e-5) -> set[str]:
    """Word forms that are `ratio` times as frequent in toxic documents as in clean ones and in too many of them for chance; of forms that begin alike the most specific that explain them.

    `docs` has the words of each document as places in `words`."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return set()
    sets = [np.unique(d) for d in docs]
    known: dict[str, int] = {}
    of_word: list[list[int] | None] = [None] * len(words)
    for d, t in zip(sets, toxic, strict=True):
        for w in d.tolist() if t else ():
            if of_word[w] is None:
                of_word[w] = [known.setdefault(f, len(known)) for f in forms(words[w])]
    for w, x in enumerate(of_word):  # of words of clean documents only those forms count that toxic ones have
        if x is None:
            of_word[w] = [known[f] for f in forms(words[w]) if f in known]
    df = np.zeros((2, len(known)), dtype=np.int64)
    for d, t in zip(sets, toxic, strict=True):
        df[int(t), list({f for w in d.tolist() for f in of_word[w]})] += 1
    least = max(3, math.log(chance) / math.log(n_toxic / (n_toxic + n_clean)))
    able = (df[1] >= least) & (df[1] / n_toxic >= ratio * df[0] / n_clean)
    where: dict[str, set[int]] = {f: set() for f, k in known.items() if able[k]}
    name = {k: f for f, k in known.items() if able[k]}
    for n, d in enumerate(sets):
        for f in {f for w in d.tolist() for f in of_word[w] if able[f]} if toxic[n] else ():
            where[name[f]].add(n)
    chosen: list[str] = []
    for f in sorted(where, key=lambda f: (f[0] != "=", -len(f), f)):
        start = f.lstrip("=456^")
        explained = set().union(*(where[g] for g in chosen if g.lstrip("=456^").startswith(start)))
        if len(where[f] - explained) >= max(3, 0.1 * len(where[f])):
            chosen.append(f)
    return set(chosen)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: 1, log odds of its greatest marginal, log of the sum of its marginals."""
    out = np.empty((len(sizes), 3))
    out[:, 0], out[:, 1], out[:, 2] = 1, -12, np.log(1e-5)
    full = sizes > 0
    if full.any():
        at = np.append(0, np.cumsum(sizes[full])[:-1])
        top = np.clip(np.maximum.reduceat(p, at), 6e-6, 1 - 6e-6)
        out[full, 1] = np.log(top / (1 - top))
        out[full, 2] = np.log(np.add.reduceat(p, at) + 1e-5)
    return out


def fit(texts: list[str], toxic: list[int], rounds: int = 40, rate: float = 0.4, ridge: float = 1e-3) -> Field | None:
    """None without documents of both kinds."""
    y_doc = np.array(toxic, dtype=bool)
    if not len(y_doc) or y_doc.all() or not y_doc.any():
        return None
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in t.split()], dtype=np.int32) for t in texts]
    own = one_of_each(texts)
    chosen = token_forms(list(vocab), [ids[k] for k in own], y_doc[own])
    sizes = np.array([len(d) for d in ids])
    word = np.concatenate(ids)
    feats = np.array([features(w) for w in vocab], dtype=np.int32)
    marked = np.array([any(f in chosen for f in forms(w)) for w in vocab])
    y = marked[word] & np.repeat(y_doc, sizes)
    ends = np.cumsum(sizes[sizes > 0])
    inner = np.ones(len(word), bool)  # words that another one of the document precedes
    inner[np.append(0, ends[:-1])] = False
    pair = np.flatnonzero(inner)
    seen = np.array([[np.sum(~y[pair - 1] & ~y[pair]), np.sum(~y[pair - 1] & y[pair])], [np.sum(y[pair - 1] & ~y[pair]), np.sum(y[pair - 1] & y[pair])]], float)
    w, trans = np.zeros(HASH), np.zeros((2, 2))
    m1, m2, n1, n2 = np.zeros(HASH), np.zeros(HASH), np.zeros((2, 2)), np.zeros((2, 2))
    for k in range(1, rounds + 1):
        emit = w[feats].sum(axis=1)[word]
        p, forward = marginals(emit, sizes, trans)
        g = np.bincount(feats.ravel(), np.repeat(np.bincount(word, p - y, minlength=len(vocab)), 8), minlength=HASH) + ridge * w
        # pair marginals: forward odds before, transition, and emission times backward odds after
        t, f, after = np.exp(trans), forward[pair - 1], p[pair] / (1 - p[pair] + 1e-300)
        b = after / np.maximum(f * t[1, 1] + t[0, 1], 1e-300) * (f * t[1, 0] + t[0, 0])
        joint = np.stack([np.full(len(f), t[0, 0]), t[0, 1] * b, f * t[1, 0], f * t[1, 1] * b])
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        h = joint - seen + ridge * trans
        for x, d, a, v in ((w, g, m1, m2), (trans, h, n1, n2)):
            a += 0.1 * (d - a)
            v += 0.01 * (d * d - v)
            x -= rate * (a / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    p, _ = marginals(w[feats].sum(axis=1)[word], sizes, trans)
    return Field(w.astype(np.float32), trans, _logistic(_summary(p, sizes), y_doc.astype(float)))


def training_sample(docs: DataFrame, labels: DataFrame, text: str = "text", toxic_rows: int = 900, clean_rows: int = 1500) -> tuple[list[str], list[int]]:
    """About so many labelled rows of each kind at most, by a hash of doc_id, and of each doc_id one: the least of its texts. Labelled rows are those given; only their doc_ids are sent to the scan of the texts."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {int(r[0] > 0): r[1] for r in one.groupBy(F.col("toxic").alias("t")).count().collect()}
    share = lambda kind, most: min(1 << 30, int(most / max(1, count.get(kind, 0)) * (1 << 30)))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.when(F.col("toxic") > 0, share(1, toxic_rows)).otherwise(share(0, clean_rows))
    some = one.where(drawn)
    found = docs.select("doc_id", F.col(text).alias("text")).where("text is not null").join(F.broadcast(some), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows = sorted({(r.text, int(r.toxic > 0)) for r in rows})
    return [r[0] for r in rows], [r[1] for r in rows]


def score(df: DataFrame, field: Field | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = True, out: str = "score") -> DataFrame:
    """`keep` columns, the score as `out`, and with `offsets` the array `offending` of {start, end, p}: the words whose marginal is over one half, in code points."""
    # a text column that is kept is read where it stands
    at = keep.index(text) if text in keep else len(keep)
    source = df.select(*keep) if text in keep else df.select(*keep, text_or_empty(text).alias(unused(df, "text")))
    schema = df.select(*keep).schema.add(out, "double")
    if offsets:
        schema = schema.add("offending", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("p", "double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for lo, hi in chunks(batch.num_rows, pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), 1 << 20):
                part = batch.slice(lo, hi - lo)
                texts = pc.fill_null(part.column(at), "").to_pylist()
                if field is None:
                    values, found = np.zeros(len(texts)), [[] for _ in texts]
                else:
                    values, found = _score(texts, field, known, offsets)
                more = [pa.array(values, pa.float64())]
                if offsets:
                    more.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *more], names=schema.names)

    return source.mapInArrow(run, schema)


def _score(texts: list[str], field: Field, known: dict[str, float], offsets: bool) -> tuple[np.ndarray, list]:
    words = [t.split() for t in texts]
    if len(known) > TABLE:
        known.clear()
    if new := list({w for d in words for w in d if w not in known}):
        known.update(zip(new, field.emissions(new).tolist(), strict=True))
    sizes = np.array([len(d) for d in words])
    emit = np.array([known[w] for d in words for w in d], dtype=np.float64)
    p, _ = marginals(emit, sizes, field.trans)
    z = np.clip(_summary(p, sizes) @ field.scale, -30, 30)
    found: list = [[] for _ in texts]
    if offsets:
        starts = np.append(0, np.cumsum(sizes))
        over = np.flatnonzero(p > 0.5)
        of = np.searchsorted(starts, over, side="right") - 1
        for k in np.unique(of):
            spans = [m.span() for m in re.finditer(r"\S+", texts[k])]
            found[k] = [{"start": spans[i - starts[k]][0], "end": spans[i - starts[k]][1], "p": float(p[i])} for i in over[of == k]]
    return 1 / (1 + np.exp(-z)), found


def learn(spark: SparkSession, sf_dir: str) -> Field | None:
    """The field of a data folder: from documents and labels, rows whose crc32(doc_id as text) mod 3 is not 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("crc32(cast(doc_id as string)) % 3 <> 1")
    return fit(*training_sample(table(spark, sf_dir, "documents"), labels))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), learn(spark, sf_dir))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
