"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all adjacent pairs by a hash of the pair
keys, finds the lowest rank in each word, and merges that pair wherever it occurs in the word, left to right. Words
that were met before come from a bounded table of the worker.

Results equal those of the public `tokenizers` library for byte-level BPE files with the usual pre-tokenizing pattern,
no normalizer and add_special_tokens=False; special tokens that stand in a text are recognised, as the library does.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; repeated rows give
repeated rows; an empty table gives an empty result; other columns of the input never matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.llm.common import table, text_or_empty, unused

#: The public pre-tokenizing pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a worker's table before it starts anew.
TABLE = 120_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level files without normalizer and prefix space are read")
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # each slot of a hash has the place of its first key and how many follow, since keys lie in the order of their slots
        self.shift = 64 - (len(pairs).bit_length() + 3)
        slot = self._slot(self.keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.ranks, slot = self.keys[order], self.ranks[order], slot[order]
        count = np.bincount(slot, minlength=1 << (64 - self.shift))
        self.most = int(count.max(initial=1))
        self.at = np.cumsum(count) - count
        self.keys = np.append(self.keys, np.full(self.most, -1))
        self.ranks = np.append(self.ranks, np.full(self.most, len(pairs)))
        value = {c: b for b, c in enumerate(letters)}
        self.bytes = {i: bytes(value[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.known_ids: dict[str, str] = {}
        self.known_bytes: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def rank(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of ranks where it's none."""
        at, none = self.at[self._slot(key)], len(self.merged)
        out = np.where(self.keys[at] == key, self.ranks[at], none)
        left = np.flatnonzero(out == none)
        for k in range(1, self.most):
            hit = left[self.keys[at[left] + k] == key[left]]
            out[hit] = self.ranks[at[hit] + k]
        return out

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where those of each word end."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        none = len(self.merged)
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            rank = np.where(word[:-1] == word[1:], self.rank(key), none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, starts)
            span = np.diff(np.append(starts, len(sym)))
            each = np.repeat(low, span)
            over = each == none
            if over.any():  # words without a pair left are whole
                done_ids.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, each = sym[keep], word[keep], rank[keep], each[keep]
                if not len(sym):
                    break
            hit = rank == each
            # of touching hits (a a a) each second one counts, from the left
            idx = np.flatnonzero(hit)
            run = np.append(0, np.cumsum(np.diff(idx) != 1)) if len(idx) else idx
            first = np.flatnonzero(np.append(True, np.diff(run) != 0))
            odd = (np.arange(len(idx)) - first[run]) % 2 == 1
            idx = idx[~odd]
            sym[idx] = self.merged[rank[idx]]
            gone = np.zeros(len(sym), dtype=bool)
            gone[idx + 1] = True
            sym, word = sym[~gone], word[~gone]
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        ids, of = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(of, kind="stable")
        return ids[order], np.cumsum(np.bincount(of, minlength=len(words)))

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens; a special token comes as it stands, with a NUL before it."""
        if self.split is None or not any(t in text for t in self.special):
            return self.words.findall(text)
        out = []
        for part in self.split.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out += self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, as decimal numbers joined by commas, and the bytes that these ids stand for."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known_ids) > TABLE:
            self.known_ids.clear()
            self.known_bytes.clear()
        if new := list(set().union(*cut).difference(self.known_ids)):
            special = [w for w in new if w[0] == "\0" and w[1:] in self.special]
            for w in special:
                self._learn([w], np.array([self.special[w[1:]]]), np.array([1]))
            plain = list(set(new).difference(special))
            for k in range(0, len(plain), 20_000):
                some = plain[k : k + 20_000]
                self._learn(some, *self.rounds([w.encode() for w in some]))
        ids, raw = self.known_ids.__getitem__, self.known_bytes.__getitem__
        return [(",".join(map(ids, words)), b"".join(map(raw, words))) for words in cut]

    def _learn(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        own, start = ids.tolist(), 0
        names, raw = list(map(str, own)), list(map(self.bytes.__getitem__, own))
        for word, end in zip(words, ends.tolist(), strict=True):
            self.known_ids[word] = ",".join(names[start:end])
            self.known_bytes[word] = b"".join(raw[start:end])
            start = end

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def model(path: str) -> ByteBPE:
    return ByteBPE(path)


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False, back: bool = True) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256 and decoded_sha256 of each row; with `ids`, also token_ids (array) and, unless `back` is false, decoded (text)."""
    source = df.select(*keep, text_or_empty(text).alias(unused(df, "text")))
    schema = df.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
        schema = schema.add("decoded", "string") if back else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                n, digest, again, lists, whole = [], [], [], [], []
                for joined, raw in own.encode(part.column(part.num_columns - 1).to_pylist()):
                    n.append(joined.count(",") + 1 if joined else 0)
                    digest.append(_sha(joined.encode()))
                    decoded = raw.decode("utf-8", errors="replace")
                    again.append(_sha(decoded.encode()))
                    if ids:
                        lists.append(np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.empty(0, np.int32))
                        whole.append(decoded)
                more = [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(again, pa.string())]
                if ids:
                    more.append(pa.array(lists, pa.list_(pa.int32())))
                    more += [pa.array(whole, pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=schema.names)

    return source.mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
