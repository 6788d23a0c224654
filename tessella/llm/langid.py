"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is cross-parsed against each: from left to right into
phrases, each the longest match that the automaton allows, across words and as long as the text goes. It costs a language
as many phrases as it needs there, times the bits that point into the labelled text. The language of least cost wins.

Only text and language of labelled rows are learned from. The sample is bounded by parameters: the `langs` most frequent
languages, and of each whole texts in the order of a hash until `rows` of them, or `chars` characters, are full (texts
longer than `chars` are passed over). All texts are parsed whole.

Defined results: a null text, or one without a letter, is `und` with score 0; without labelled rows every text is `und`;
of languages with equal costs the first by name wins; rows without language are not learned from; a text that repeats is
learned from once; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import table, unused

#: Runs of letters.
LETTERS = re.compile(r"[^\W\d_]+")


#: Drawn texts whose keys are broadcast; more are joined as Spark sees fit.
FEW = 100_000
#: Letters after which languages are compared while a text is parsed.
STEP = 256


def letters_of(text: str) -> str:
    """Lower-cased runs of letters, with single spaces around each; empty without any."""
    words = LETTERS.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


#: A state of an automaton: the states that characters lead to.
State = dict[str, "State"]


def suffix_automaton(text: str) -> State:
    """The start of the automaton that accepts the substrings of a text."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    # states in place of their numbers, which spares parsing a look-up for each character
    for state in step:
        for c, to in state.items():
            state[c] = step[to]
    return step[0]


def walk(text: str, at: State, root: State) -> tuple[int, State]:
    """From a state on: how many phrases end in a text before its last one does, and the state behind it; a letter that never occurs is a phrase of its own."""
    n = 0
    for c in text:
        to = at.get(c)
        if to is None:
            n += at is not root  # the phrase before ends
            to = root.get(c)
            if to is None:
                n += 1
                to = root
        at = to
    return n, at


def phrases(text: str, root: State) -> int:
    """Longest matches, one after another, that a text takes."""
    n, at = walk(text, root, root)
    return n + (at is not root)


class Parser:
    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.roots = [suffix_automaton(samples[x]) for x in self.langs]
        self.bits = np.array([np.log2(2 + len(samples[x])) for x in self.langs])

    def costs(self, texts: list[str]) -> np.ndarray:
        """What each text (row) costs each language. The two least are exact; a language is left once it costs more than two others."""
        out = np.zeros((len(texts), len(self.langs)))
        # one language after another, so that what is read of its automaton stays at hand
        begun = [[walk(t[:STEP], root, root) for t in texts] for root in self.roots]
        first = np.array([[n for n, _ in x] for x in begun], dtype=float).reshape(len(self.langs), -1).T * self.bits
        hopeful = np.zeros(out.shape, dtype=bool)
        np.put_along_axis(hopeful, np.argsort(first, axis=1, kind="stable")[:, :2], True, axis=1)
        for k, root in enumerate(self.roots):
            for i in np.flatnonzero(hopeful[:, k]):
                n, at = begun[k][i]
                more, at = walk(texts[i][STEP:], at, root)
                out[i, k] = (n + more + (at is not root)) * self.bits[k]
        most = out.max(axis=1, initial=0)
        for k, root in enumerate(self.roots):
            for i in np.flatnonzero(~hopeful[:, k]):
                n, at = begun[k][i]
                for lo in range(STEP, len(texts[i]), STEP):
                    if n * self.bits[k] > most[i]:
                        break
                    more, at = walk(texts[i][lo : lo + STEP], at, root)
                    n += more
                out[i, k] = (n + (at is not root)) * self.bits[k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        own = [letters_of(t) if t and self.langs else "" for t in texts]
        read = [i for i, t in enumerate(own) if t]
        if not read:
            return langs, scores
        for i, cost in zip(read, self.costs([own[i] for i in read]), strict=True):
            order = np.argsort(cost, kind="stable")
            best = float(cost[order[0]])
            other = float(cost[order[1]]) if len(order) > 1 else 0.0
            langs[i] = self.langs[order[0]]
            scores[i] = other / (best + other) if other else 1.0
        return langs, scores


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """Made once in a worker, whatever the number of its tasks."""
    return Parser(dict(samples))


def training_sample(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = 120, chars: int = 80_000) -> dict[str, str]:
    """Labelled text of each language: different whole texts in the order of their hashes, `rows` of them and `chars` characters at most.

    Texts longer than `chars` come last, and a language that has no others is learned from one of them. Every language is learned."""
    own = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    own = own.withColumn("h", F.xxhash64("text", F.lit(8)))
    keys = own.groupBy("lang", "h").agg(F.max(F.char_length("text")).alias("n"))
    # ranked within each task first, so that a task sends `rows` of each language at most
    order = W.partitionBy("lang").orderBy(F.col("n") > chars, "h")
    keys = keys.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    keys = keys.withColumn("sum", F.sum("n").over(order)).where((F.col("sum") <= chars) | (F.col("place") == 1))
    # `rows` of each language at most
    drawn = [(r.lang, r.h) for r in keys.select("lang", "h").collect()]
    if not drawn:
        return {}
    side = labelled.sparkSession.createDataFrame(drawn, "lang string, h long")
    some = own.join(F.broadcast(side) if len(drawn) <= FEW else side, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(some.collect(), key=lambda r: (r.lang, r.h)):
        out.setdefault(r.lang, []).append(letters_of(r.text).strip())
    return {k: f" {' '.join(v)} " for k, v in out.items() if any(v)}


def identify(df: DataFrame, samples: dict[str, str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred and score (the runner-up's share of the two least costs)."""
    source = df.select(*keep, F.col(text).alias(unused(df, "text")))
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    known = tuple(samples.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(known)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs, scores = own.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.expr("crc32(cast(doc_id as string)) % 5")
    found = identify(docs, training_sample(docs.where(fold != 0)))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
