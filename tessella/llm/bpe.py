"""BPE with word ends: encoding by batched merge rounds in numpy, and decoding.

A block of texts becomes one array of code points; words are cut by character class, and the block's distinct words go
into one flat array of symbols. Each round looks all adjacent pairs up by binary search over the sorted pair keys,
finds each word's lowest rank, merges that pair wherever the word holds it, and compacts the array; words without a
mergeable pair leave. A text's ids are those of its words in order. No Python object is made for a word.

Defined cases: a null text is empty and has no ids; strings of special tokens inside a text become their ids, as the
tokenizers library has it; nothing is truncated or padded. Equal words are found by a 64-bit hash. Letters and numbers
are those of the regex package's Unicode tables.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.wordhash import mix, powers

BLOCK_CHARS = 1 << 21
#: Words whose ids a worker process keeps; beyond it the table starts anew, with the same results.
KNOWN_WORDS = 500_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Endings that a lone apostrophe takes along, as the file's split pattern has them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[offsets[i] : offsets[i + 1]] for each i of index, end to end, and their offsets."""
    first = offsets[index]
    ends = np.concatenate([[0], np.cumsum(offsets[index + 1] - first)])
    at = np.repeat(first - ends[:-1], np.diff(ends))
    at += np.arange(len(at))
    return flat[at], ends


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(0x100 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizers JSON file of model BPE with an end-of-word suffix, a split by character class and byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        if next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split") != PATTERN:
            raise ValueError("the file splits words by another pattern")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.known = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, np.int32)
        self.decimal = self._table(f"{i} ".encode() for i in range(len(self.tokens)))
        self.text = self._table(f"{t} ".encode() for t in self.tokens)

    @staticmethod
    def _table(values: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values = list(values)
        return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])])

    def merge_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as UTF-8 bytes end to end and their lengths (none is empty); the words' offsets in ids."""
        ends = np.cumsum(lengths) - 1
        ids = self.inner[data]
        ids[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_word = [], []
        none = len(self.keys)
        rank = np.full(len(ids), none)
        fresh = np.arange(len(ids) - 1)  # places of pairs that the last round made
        while len(ids):
            fresh = fresh[word[fresh] == word[fresh + 1]]
            key = ids[fresh] << 32 | ids[fresh + 1]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank[fresh] = np.where(self.keys[at] == key, self.ranks[at], none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = lowest == none
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, rank, lowest = ids[~over], word[~over], rank[~over], lowest[~over]
                if not len(ids):
                    break
            hit = rank == lowest
            # in a run of overlapping hits ("aaaa") every second one is merged, from its start
            first = hit & ~np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - run) % 2 == 0
            ids = np.where(hit, self.merged[np.where(hit, rank, 0)], ids)
            keep = ~np.append(False, hit[:-1])
            rank[hit] = none
            rank[:-1][hit[1:]] = none
            ids, word, rank, hit = ids[keep], word[keep], rank[keep], np.flatnonzero(hit[keep])
            fresh = np.concatenate([hit, hit - 1])
            fresh = fresh[(fresh >= 0) & (fresh < len(ids) - 1)]
            rank[-1:] = none
            rank[fresh] = none
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(lengths)))])

    @staticmethod
    def normalized(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case letter by letter: no final sigma
            text = text.replace("Σ", "σ")
        return text.lower()

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's offset."""
        if self.split_special and any(t and "<|" in t and self.split_special.search(t) for t in texts):
            return self._with_special(texts)
        plain = [self.normalized(t) if t else "" for t in texts]
        points = np.frombuffer("\n".join([*plain, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in plain])])
        kind = classes()[points]
        before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
        start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        # a lone apostrophe takes one of the endings along
        for e in ENDINGS:
            if not len(points) > len(e):
                continue
            at = np.flatnonzero((points[: -len(e)] == 39) & start[: -len(e)])
            for k, letter in enumerate(e):
                at = at[points[at + 1 + k] == ord(letter)]
            at = at[start[at + 1]]
            start[at + 1] = False
            after = at + 1 + len(e)
            after = after[after < len(points)]
            start[after[kind[after] == LETTER]] = True
        start = np.flatnonzero(start)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        # a word ends where the next begins or a space stands
        space = np.flatnonzero(kind == SPACE)
        end = np.minimum(np.append(start[1:], len(points)), space[np.searchsorted(space, start)])
        up, down = powers(len(points))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])])
        hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        known, at, ids = self.known
        new = np.ones(len(distinct), bool)
        if len(known):
            new = known[np.minimum(np.searchsorted(known, distinct), len(known) - 1)] != distinct
        if new.any():
            if len(known) + new.sum() > KNOWN_WORDS:
                known, at, ids, new = known[:0], at[:0], ids[:0], np.ones(len(distinct), bool)
            first = one[new]
            # UTF-8 of the new words
            text, cut = gather(points, np.stack([start[first], end[first]], 1).ravel(), 2 * np.arange(len(first)))
            size = np.concatenate([[0], np.cumsum(1 + (text > 0x7F) + (text > 0x7FF) + (text > 0xFFFF).astype(np.int64))])
            data = text.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            more, offsets = self.merge_words(np.frombuffer(data, np.uint8), np.diff(size[cut]))
            at = np.concatenate([at, np.stack([offsets[:-1], offsets[1:]], 1) + len(ids)])
            ids = np.concatenate([ids, more.astype(np.int32)])
            known = np.concatenate([known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known = known, at, ids = known[order], at[order], ids
        out, ends = gather(ids, at.ravel(), 2 * np.searchsorted(known, distinct)[which])
        return out, ends[np.searchsorted(start, firsts)]

    def _with_special(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.split_special.split(t) if t else [""] for t in texts]
        ids, offsets = self.encode_block([None if p in self.special else p for x in parts for p in x])
        out, ends, k = [], [0], 0
        for x in parts:
            for p in x:
                out.append(np.array([self.special[p]]) if p in self.special else ids[offsets[k] : offsets[k + 1]])
                k += 1
            ends.append(len(out))
        sizes = np.concatenate([[0], np.cumsum([len(o) for o in out])])
        return np.concatenate([*out, np.zeros(0, np.int64)]), sizes[np.array(ends)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_block([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(2)
def load(path: str) -> WordBpe:
    """One instance for each worker process."""
    return WordBpe(path)


def text_blocks(column: pa.Array, max_chars: int = BLOCK_CHARS) -> Iterator[list[str | None]]:
    """Values of a text column in lists of about max_chars characters."""
    out: list[str | None] = []
    size = 0
    for x in column:
        v = x.as_py()
        out.append(v)
        size += len(v or "")
        if size >= max_chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: encode, then decode, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for block in text_blocks(batch.column(1)):
                ids, offsets = bpe.encode_block(block)
                counts += np.diff(offsets).tolist()
                for table, out in ((bpe.decimal, encoded), (bpe.text, decoded)):
                    flat, ends = gather(*table, ids)
                    flat, cut = flat.tobytes(), ends[offsets].tolist()
                    # each token's piece ends in a space, which the last one doesn't have
                    out += [hashlib.sha256(flat[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>); a column of that name is replaced."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        bpe = load(path)
        values, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for block in text_blocks(column):
            flat, offsets = bpe.encode_block(block)
            values.append(flat)
            sizes.append(np.diff(offsets))
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))

    return docs.withColumn(ids, run(F.col(text).cast("string")))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with a text column decoded from token ids; null ids give a null text."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([None if x is None else bpe.decode(x) for x in column.to_pylist()], pa.string())

    return docs.withColumn(text, run(F.col(ids)))
