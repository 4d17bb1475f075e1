"""Chat formatting at the level of tokens.

A turn becomes `<|im_start|>` role `<|im_sep|>` text `<|im_end|>`, where the three marks are reserved ids that no text
can produce: role and text are encoded separately, without special tokens, and the ids are spliced between. Control
strings inside texts are escaped as well, so that the formatted text is as unambiguous as the ids: `<`, any number of
backslashes, `|` gets one more backslash. Reading back removes one. The loss mask of a turn is the prefix sum of +1
where an assistant text begins and -1 where it ends; token_start, the place of a turn in its conversation, is the prefix
sum of the token counts before it.

A conversation is never gathered: its rows are one per turn, and digests stream over sorted rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm import bpe
from paylens.llm.common import map_in_arrow, text_bytes

#: The pattern that splits text before merges, and the control strings.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer texts are encoded by `bpe`, in linear time and bounded memory also where one run is very long. The ids are the same.
LONG = 1 << 15

_escape = re.compile(r"<(\\*)\|")
_unescape = re.compile(r"<\\(\\*)\|")
_encodings: dict[int, object] = {}


@dataclass(frozen=True)
class Template:
    """Roles whose texts are trained on."""

    loss_roles: tuple[str, ...] = ("assistant",)


def escape(text: str) -> str:
    return _escape.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"<\1|", text)


class Codec:
    """Encoder of a rank file; reserved ids follow the highest rank."""

    def __init__(self, rank_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.start = max(ranks.values()) + 1
        self.sep, self.end = self.start + 1, self.start + 2
        self.marks = {self.start: START, self.sep: SEP, self.end: END}
        self.ranks = ranks
        self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def of_long_texts(self) -> bpe.Tokenizer:
        return bpe.Tokenizer(self.ranks, SPLIT)

    def encode(self, text: str) -> list[int]:
        if len(text) > LONG:
            return np.frombuffer(self.of_long_texts.encode(text), "<u4").tolist()
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def turn(self, role: str, text: str, loss: bool) -> tuple[np.ndarray, np.ndarray]:
        head, body = self.encode(escape(role)), self.encode(escape(text))
        ids = np.array([self.start, *head, self.sep, *body, self.end], np.int32)
        steps = np.zeros(len(ids) + 1, np.int8)
        steps[len(head) + 2] += loss
        steps[len(head) + 2 + len(body)] -= loss
        return ids, np.cumsum(steps)[:-1].astype(np.int8)

    def read_turn(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, text under the mask, and length of the formatted text, from ids alone."""
        if ids[0] != self.start or ids[-1] != self.end or (ids >= self.start).sum() != 3:
            raise ValueError("not a turn")
        sep = int(np.flatnonzero(ids == self.sep)[0])
        role, text = self.decode(ids[1:sep]), self.decode(ids[sep + 1 : -1])
        under = self.decode(ids[mask.astype(bool)])
        return unescape(role), unescape(text), unescape(under), len(role) + len(text) + sum(map(len, self.marks.values()))


def codec_of(spark: SparkSession, vocabulary: str) -> Callable[[], Codec]:
    """A function that gives a task its codec. The rank file is read here, once, and broadcast (a few MB at most)."""
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    key = hash(vocabulary)

    def codec() -> Codec:
        if key not in _encodings:
            _encodings[key] = Codec(sent.value)
        return _encodings[key]

    return codec


def format_turns(turns: DataFrame, vocabulary: str = VOCABULARY, template: Template = Template()) -> DataFrame:
    """One row per row of turns (conv_id, turn, role, text): conv_id, turn, role, order_key, n_tokens, token_ids, loss_mask.

    token_ids holds 32-bit little-endian ids, loss_mask one byte for each. Null role or text: empty. order_key, the
    first 15 hexadecimal digits of the text's MD5, orders turns of equal number and role.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("order_key", pa.int64())]
        + [("n_tokens", pa.int64()), ("token_ids", pa.binary()), ("loss_mask", pa.binary())]
    )
    codec = codec_of(turns.sparkSession, vocabulary)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("order_key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in batches:
            made = [c.turn(r, t, r in template.loss_roles) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist())]
            columns = [batch["conv_id"], batch["turn"], batch["role"], batch["order_key"]]
            columns += [pa.array([len(ids) for ids, _ in made], pa.int64())]
            columns += [pa.array([ids.tobytes() for ids, _ in made], pa.binary()), pa.array([m.tobytes() for _, m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_in_arrow(rows, run, "conv_id long, turn long, role string, order_key long, n_tokens long, token_ids binary, loss_mask binary")


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY, template: Template = Template()) -> DataFrame:
    """format_turns with token_start. In a conversation, rows ordered by token_start concatenate to its sample.

    Turns are ordered by turn (null first), then role, then order_key. A null conv_id is a conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "order_key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    return format_turns(turns, vocabulary, template).withColumn("token_start", start)


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, from the ids and masks alone: conv_id, n_turns, n_tokens, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Rows stream in order; a task holds one turn of a conversation at a time.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("turns_sha256", pa.string())]
        + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    codec = codec_of(formatted.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, state, done = codec(), object(), None, []

        def close() -> None:
            if state:
                n, tokens, turns, chars, loss, formatted_chars = state
                done.append((now, n, tokens, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars))

        for batch in batches:
            for conv, start, ids, mask in zip(*(batch[k].to_pylist() for k in ("conv_id", "token_start", "token_ids", "loss_mask"))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                tokens = np.frombuffer(ids, np.int32)
                if start != state[1]:
                    raise ValueError(f"turns of conversation {conv} do not follow each other")
                role, text, under, chars = c.read_turn(tokens, np.frombuffer(mask, np.int8))
                state[0] += 1
                state[1] += len(tokens)
                for part in (role, "\n", text, "\n"):
                    state[2].update(text_bytes(part))
                state[3] += len(under)
                state[4].update(text_bytes(under))
                state[5] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    rows = formatted.select("conv_id", "token_start", "token_ids", "loss_mask")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "token_start")
    return map_in_arrow(rows, run, "conv_id long, n_turns long, n_tokens long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
