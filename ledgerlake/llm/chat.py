"""Chat formatting at the level of tokens.

Each turn is encoded on its own and reserved ids, which no text encodes to, are spliced
around it, so no content can forge a boundary. Control strings in a content are escaped
on top of that, so that the text form of a conversation can be split again: in a
content, an escape character goes in front of each escape character and behind the
first character of each control string, which breaks it. A prefix sum over segment lengths gives every token its place
and the loss mask its spans.

``encode_turns`` works row by row; ``assemble`` streams rows sorted by conversation and
turn through the worker and holds one conversation's running sums, not its rows, so a
conversation may be of any length.

Defined results: a null text is empty; a null role is an empty one; a null conversation
id is one conversation; equal turns keep a fixed order (by role, then text); an empty
table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, table

DEFAULT_FILE = "byte_bpe_50k.tiktoken"
ESCAPE = "\\"
#: Strings with a meaning in this template or in common others.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, SEPARATOR, END = CONTROL[0], CONTROL[2], CONTROL[1]
LOSS_ROLE = "assistant"
#: White space that the tokenizer's own pattern would search by recursion.
_LONG_SPACE = regex.compile(r"\p{White_Space}{1000,}")
_TO_ESCAPE = regex.compile("|".join(map(regex.escape, (ESCAPE, *CONTROL))))


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return regex.sub(r"(?s)\\(.)", r"\1", text)


class Tokens:
    """A byte-level vocabulary, three reserved ids above it, and an offset table to decode with."""

    def __init__(self, file: str | None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(file or public_tokenizers.path(DEFAULT_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        most = max(ranks.values())
        self.start, self.separator, self.end = most + 2, most + 3, most + 4
        items = [b""] * (most + 5)
        for token, i in ranks.items():
            items[i] = token
        items[self.start], items[self.separator], items[self.end] = START.encode(), SEPARATOR.encode(), END.encode()
        self.block = np.frombuffer(b"".join(items), dtype=np.uint8)
        self.offsets = np.cumsum([0, *map(len, items)])

    def encode(self, text: str) -> list[int]:
        """The ids of a text. A long run of white space is one piece but for its last character, if more follows."""
        found, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            found += self.encoding.encode_ordinary(text[at : m.start()]) + self.encoding._encode_single_piece(text[m.start() : end].encode())
            at = end
        return found + self.encoding.encode_ordinary(text[at:])

    def segments(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """The ids of a turn, and where its escaped content begins and ends among them."""
        head = [self.start, *self.encode(escape(role)), self.separator]
        body = self.encode(escape(text))
        return np.array([*head, *body, self.end], dtype=np.int32), len(head), len(head) + len(body)

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        shift = self.offsets[ids] - (np.cumsum(lengths) - lengths)
        return self.block[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes().decode()


@cache
def tokens(file: str | None) -> Tokens:
    return Tokens(file)


def encode_turns(rows: DataFrame, file: str | None = None) -> DataFrame:
    """conv_id, turn, ids, body_start, body_end and loss (long flags) of every row of a conversation table."""
    on_workers(rows.sparkSession)
    made = pa.struct([("ids", pa.list_(pa.int32())), ("body_start", pa.int64()), ("body_end", pa.int64()), ("loss", pa.int64())])

    @F.arrow_udf("ids array<int>, body_start long, body_end long, loss long")
    def run(roles: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for role, text in zip(roles.to_pylist(), texts.to_pylist(), strict=True):
            ids, a, b = tokens(file).segments(role, text)
            out.append({"ids": ids, "body_start": a, "body_end": b, "loss": int(role == LOSS_ROLE)})
        return pa.array(out, type=made)

    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.withColumn("t", run("role", "text")).select("conv_id", "turn", "role", "text", "t.*")


def _sorted_by_turn(rows: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order; ties by role and text."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *[c for c in ("ids", "body_start", "body_end", "loss") if c in rows.columns])
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def assemble(turns: DataFrame, in_order: bool = False) -> DataFrame:
    """Each turn's ids with its place in its conversation: conv_id, position, ids, first_token, loss_start, loss_end.

    ``first_token`` is the prefix sum of the lengths before it; tokens from loss_start to
    loss_end (both counted in the conversation) are under the loss mask, none if equal.
    Turns that are ``in_order`` are not shuffled again.
    """
    on_workers(turns.sparkSession)
    schema = "conv_id long, position long, ids array<int>, first_token long, loss_start long, loss_end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, at = object(), 0, 0
        for batch in batches:
            conv = batch.column("conv_id").to_pylist()
            lengths = batch.column("ids").value_lengths().to_pylist()
            out: dict[str, list[int]] = {"position": [], "first_token": [], "loss_start": [], "loss_end": []}
            for k, (c, a, b, loss) in enumerate(zip(conv, *(batch.column(x).to_pylist() for x in ("body_start", "body_end", "loss")), strict=True)):
                if c != current:
                    current, position, at = c, 0, 0
                out["position"].append(position)
                out["first_token"].append(at)
                out["loss_start"].append(at + a)
                out["loss_end"].append(at + (b if loss else a))
                position, at = position + 1, at + lengths[k]
            made = {"conv_id": batch.column("conv_id"), "position": out["position"], "ids": batch.column("ids"), **{k: out[k] for k in ("first_token", "loss_start", "loss_end")}}
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in made.values()], names=list(made))

    return (turns if in_order else _sorted_by_turn(turns)).drop("text", "role").mapInArrow(run, schema)


def read_back(assembled: DataFrame, file: str | None = None) -> DataFrame:
    """One row a conversation, from ids and loss spans alone.

    Decoded ids are split at the reserved ones, contents unescaped, and digests fed turn
    by turn, so memory holds one batch. ``formatted_chars`` counts the code points of the
    decoded conversation, ``loss_chars`` those of the unescaped text under the mask.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(file)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, state = object(), None
        done: list[tuple] = []

        def finished() -> tuple:
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def packed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("conv_id", "first_token", "loss_start", "loss_end")]
            for ids, c, first, a, b in zip(batch.column("ids"), *columns, strict=True):
                if c != current or state is None:
                    if state is not None:
                        done.append(finished())
                    current, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = ids.values.to_numpy()
                middle = int(np.flatnonzero(ids == t.separator)[0])
                role, text = t.decode(ids[1:middle]), t.decode(ids[middle + 1 : -1])
                masked = unescape(t.decode(ids[a - first : b - first]))
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(role) + len(text) + len(START) + len(SEPARATOR) + len(END)
            yield packed()
            done.clear()
        if state is not None:
            done.append(finished())
            yield packed()

    return assembled.mapInArrow(run, schema)


def format_conversations(rows: DataFrame, file: str | None = None) -> DataFrame:
    """The assembled token form of a conversation table (conv_id, turn, role, text)."""
    # texts are shuffled, not the longer ids
    return assemble(encode_turns(_sorted_by_turn(rows.select("conv_id", "turn", "role", "text")), file), in_order=True)


PROBE_TEXT = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, conversation -1, read back from its token form."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{PROBE_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return read_back(format_conversations(rows.unionByName(probe)))


def oracle() -> str:
    alternatives = "|".join("".join("\\" + c if c in r"\[]|/<>" else c for c in x) for x in (ESCAPE, *CONTROL))
    escaped = lambda c: f"length(regexp_replace({c}, '({alternatives})', '#\\1', 'g'))"
    frame = len(START) + len(SEPARATOR) + len(END)
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}')))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum({escaped("role")} + {escaped("text")} + {frame}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
