"""Byte-pair encoding by backtracking over longest matches, decoding by an offset table.

Encoding a pre-token in linear time: an Aho-Corasick automaton over the vocabulary
gives, for each position, the tokens that start there. The encoder takes the longest
token that is compatible with its left neighbour, falls back to shorter ones, and
steps back where none fits. Two neighbours are compatible if merging by rank would
leave the boundary between them alone; a token sequence is the one that merging by rank
gives exactly if all neighbours are compatible, so the prefix up to a position has one
such sequence only, and a position once given up is never tried again.

Decoding (and writing ids as decimal numbers) gathers bytes from one table with
offsets, without a loop over tokens.

A worker's memory is one Arrow batch plus caches that are emptied at a fixed number of bytes; rows
are independent, so a lost executor costs only the recomputation of its partitions.
Defined results: a null text is an empty one and has no tokens; an empty table gives
an empty table; repeated rows give repeated results; columns of the given names are
replaced and all others are kept.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ByteMemo as Memo
from .common import on_workers, table
from .pyexec import struct_udf

DEFAULT_FILE = "word_bpe_49k.json"
#: Bytes that a worker remembers.
CACHES = {"pairs": 24 << 20, "chunks": 48 << 20, "words": 48 << 20}
INFINITE = 1 << 60
END = "\0"
#: Separators of str.split() that the tokenizer does not regard as white space.
ODD_SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACE_RUN = regex.compile(r"\p{White_Space}+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class OffsetTable:
    """Byte strings, each followed by a separator, in one block with offsets."""

    def __init__(self, items: list[bytes], separator: bytes = b" "):
        self.block = np.frombuffer(separator.join(items) + separator, dtype=np.uint8)
        self.offsets = np.cumsum([0, *(len(x) + len(separator) for x in items)], dtype=np.int32)
        self.tail = len(separator)

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        starts, ends = self.offsets[ids], self.offsets[ids + 1]
        lengths = ends - starts
        ends = np.cumsum(lengths, dtype=np.int64)
        wide = np.int64 if ends[-1] > 2**31 - 1 else np.int32
        places = np.repeat((starts - ends + lengths).astype(wide), lengths)
        places += np.arange(ends[-1], dtype=wide)
        return self.block[places[: -self.tail]].tobytes()


class Bpe:
    """Encoder and decoder for a tokenizer file with end-of-word tokens.

    ``file`` is the path of a tokenizer in the JSON form of the tokenizers library whose
    normalizer is NFC, white space to blanks, lower case, and whose pre-tokenizer is one
    inverted split pattern followed by the byte alphabet.
    """

    def __init__(self, file: str):
        import ahocorasick

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        marked = lambda t: t.removesuffix(suffix) + END if t.endswith(suffix) else t
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.formed: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = vocab[a.removesuffix(suffix) + b if a.endswith(suffix) else a + b]
            self.rank[vocab[a], vocab[b]] = k
            if joined not in self.halves:
                self.halves[joined], self.formed[joined] = (vocab[a], vocab[b]), k
        self.compatible = Memo(lambda pair: self._untouched(*pair, INFINITE), CACHES["pairs"])
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i not in self.halves or self._untouched(*self.halves[i], self.formed[i]):
                text = marked(token)
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.alphabet = byte_alphabet()
        names = {i: t for t, i in (vocab | self.special).items()}
        self.names = OffsetTable([names.get(i, "").encode() for i in range(max(names) + 1)])
        self.decimals = OffsetTable([str(i).encode() for i in range(max(names) + 1)])
        self.chunks = Memo(self._encode_chunk, CACHES["chunks"])
        self.words = Memo(self._encode_word, CACHES["words"])

    def _spine(self, token: int, side: int, limit: int) -> list[tuple[int, int]]:
        """The tokens along one edge of a merge tree, each with the rank at which it ends."""
        found = [(token, limit)]
        while token in self.halves:
            limit = self.formed[token]
            token = self.halves[token][side]
            found.append((token, limit))
        return found

    def _untouched(self, left: int, right: int, limit: int) -> bool:
        """Whether merging by rank makes both tokens with no merge across their boundary before ``limit``.

        A pair across the boundary would merge if its rank comes before both of its sides
        have merged inward; at equal rank the pair further left goes first.
        """
        inner = self._spine(right, 0, limit)
        for x, x_ends in self._spine(left, 1, limit):
            for y, y_ends in inner:
                k = self.rank.get((x, y))
                if k is not None and k < x_ends and (k <= y_ends if y_ends < limit else k < limit):
                    return False
        return True

    def _encode_word(self, word: str) -> bytes:
        alphabet = self.alphabet
        text = (word if word.isascii() and word.isprintable() else "".join([alphabet[b] for b in word.encode()])) + END
        size, compatible = len(text), self.compatible
        starting: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            starting[end - match[1] + 1].append(match)
        given_up = bytearray(size + 1)
        taken: list[int] = []
        steps: list[tuple[int, int]] = []
        at, last = 0, -1
        here = starting[0]
        choice = len(here) - 1
        while at < size:
            while choice >= 0:
                token, length = here[choice]
                if not given_up[at + length] and (last < 0 or compatible[last, token]):
                    break
                choice -= 1
            else:
                if not taken:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                given_up[at] = 1
                at, choice = steps.pop()
                taken.pop()
                last = taken[-1] if taken else -1
                here = starting[at]
                choice -= 1
                continue
            taken.append(token)
            steps.append((at, choice))
            at, last = at + length, token
            if at < size:
                here = starting[at]
                choice = len(here) - 1
        return array("i", taken).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        found = []
        for part in self.special_split.split(chunk) if self.special_split and self.special_split.search(chunk) else [chunk]:
            if part in self.special:
                found.append(array("i", [self.special[part]]).tobytes())
            elif part:
                plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += [self.words[word] for word in self.pattern.findall(plain)]
        return b"".join(found)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; words between white space are encoded once and remembered."""
        if not text:
            return np.empty(0, dtype=np.int32)
        parts = SPACE_RUN.split(text) if ODD_SEPARATORS.search(text) else text.split()
        chunks = self.chunks
        return np.frombuffer(b"".join([chunks[x] for x in parts]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids with a blank between two, special ones included."""
        return self.names.join(ids).decode()

    def spelled(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers with a blank between two."""
        return self.decimals.join(ids)


@cache
def codec(file: str | None) -> Bpe:
    """The worker's codec; by default the public vocabulary, found where the worker has it."""
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path(DEFAULT_FILE)
    return Bpe(str(file))


def encode(df: DataFrame, text: str = "text", file: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` with the array of ids of each text."""
    on_workers(df.sparkSession)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        made = [codec(file).encode(x) for x in texts.to_pylist()]
        offsets = np.cumsum([0, *(len(x) for x in made)], dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, np.concatenate([*made, np.empty(0, dtype=np.int32)]))

    return df.withColumn(ids, run(F.col(f"`{text}`")))


def decode(df: DataFrame, ids: str = "ids", file: str | None = None, text: str = "decoded") -> DataFrame:
    """``df`` with the text that each array of ids stands for; null ids give an empty text."""
    on_workers(df.sparkSession)

    @F.arrow_udf("string")
    def run(arrays: pa.Array) -> pa.Array:
        flat, ends = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *(x or 0 for x in arrays.value_lengths().to_pylist())])
        return pa.array([codec(file).decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], type=pa.string())

    return df.withColumn(text, run(F.col(f"`{ids}`")))


DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(df: DataFrame, text: str = "text", file: str | None = None, into: str = "_bpe") -> DataFrame:
    """``df`` with a struct: the number of ids and the digests of the ids and of what they decode to.

    Encoding and decoding happen in one visit of the worker, so neither ids nor decoded
    texts travel.
    """
    on_workers(df.sparkSession)

    def run(texts: pa.Array) -> dict[str, list]:
        c, made = codec(file), {f.name: [] for f in DIGESTS}
        for x in texts:
            ids = c.encode(x.as_py())
            made["n_tokens"].append(len(ids))
            made["ids_sha256"].append(hashlib.sha256(c.spelled(ids)).hexdigest())
            made["decoded_sha256"].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return made

    return df.withColumn(into, struct_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string", DIGESTS)(F.col(f"`{text}`")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_bpe.*")
