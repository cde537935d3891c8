"""Chat formatting on tokens: segments are encoded separately, reserved ids are spliced in, masks are prefix sums.

A turn becomes ``<|turn|>`` role ``<|body|>`` text ``<|end|>``. The three marks are ids above the tokenizer's
vocabulary, so no text can produce them; control strings inside a text are escaped as well, reversibly, so that the
formatted string can't be misread either. The loss mask covers what lies between body and end of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tokenizer_path

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
MARKS = [TURN, BODY, END]
# Control strings of common chat templates and of this one.
CONTROL = ["<|turn|>", "<|body|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
LOSS_ROLE = "assistant"
ROWS = "conv_id long, turn long, role string, text string"
SEGMENTS = "conv_id long, turn long, role string, text string, tokens binary, loss_mask binary"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def _join(match: re.Match, slash: str) -> str:
    a, b, c = (x for x in match.groups() if x is not None)
    return a + slash + b + c


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string; one more where there are some already."""
    return _ESCAPE.sub(lambda m: _join(m, "\\"), text)


def unescape(text: str) -> str:
    """Undo escape(): take one backslash away from each control string that has some."""
    return _UNESCAPE.sub(lambda m: _join(m, ""), text)


def encode_turns(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every turn as token ids and mask (little-endian uint32 and one byte an id, both as binary), still without order.

    Rows are independent here, so the costly part spreads evenly however many turns one conversation has.
    Null role and null text count as empty. Other columns are ignored.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True
        first = coder.get_vocab_size()
        turn, body, end = (np.array([first + i], "<u4") for i in range(len(MARKS)))
        encoded: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1000):
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for r in set(roles) - encoded.keys():
                if len(encoded) > 1000:
                    encoded.clear()
                encoded[r] = np.array(coder.encode(escape(r), add_special_tokens=False).ids, "<u4")
            names = [encoded[r] if r in encoded else np.array(coder.encode(escape(r), add_special_tokens=False).ids, "<u4") for r in roles]
            tokens, masks = [], []
            for role, name, got in zip(roles, names, coder.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False), strict=True):
                ids = np.concatenate([turn, name, body, np.array(got.ids, "<u4"), end])
                step = np.zeros(len(ids), np.int8)
                if role == LOSS_ROLE and len(got.ids):
                    step[len(name) + 2] += 1  # the answer's first id
                    step[len(ids) - 1] -= 1  # the end mark
                tokens.append(ids.tobytes())
                masks.append(np.cumsum(step, dtype=np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles), pa.array(texts), pa.array(tokens, pa.binary()), pa.array(masks, pa.binary())], names=["conv_id", "turn", "role", "text", "tokens", "loss_mask"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SEGMENTS)


def assemble(segments: DataFrame) -> DataFrame:
    """Segments in order: by conversation, then turn (null first), role, text. Streaming over sorted rows, so a long conversation is never held."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def read_back(assembled: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation, from tokens and masks alone. Needs assemble()'s order; holds one turn at a time.

    Rows without conversation id form one conversation of id null. An empty table gives no rows.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        first = coder.get_vocab_size()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        here: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if here is not None:
                done.append((here[0], here[1], here[2].hexdigest(), here[3], here[4].hexdigest(), *here[5:]))

        for batch in slices(batches, 1000):
            ids = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
            masks = [np.frombuffer(x, np.int8) for x in batch.column(2).to_pylist()]
            parts: list[list[int]] = []
            for row, mask in zip(ids, masks, strict=True):
                mid, end = int(np.nonzero(row == first + 1)[0][0]), len(row) - 1
                parts += [row[1:mid].tolist(), row[mid + 1 : end].tolist(), row[np.nonzero(mask)[0]].tolist()]
            texts = coder.decode_batch(parts, skip_special_tokens=False)
            for k, (conv, row, mask) in enumerate(zip(batch.column(0).to_pylist(), ids, masks, strict=True)):
                if here is None or here[0] != conv:
                    close()
                    here = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text, loss = texts[3 * k : 3 * k + 3]
                here[5] += len(role) + len(text) + sum(map(len, MARKS))
                role, text, loss = unescape(role), unescape(text), unescape(loss)
                here[1] += 1
                here[2].update(f"{role}\n{text}\n".encode("utf-8"))
                here[3] += len(loss)
                here[4].update(loss.encode())
                here[6] += len(row)
                here[7] += int(mask.sum())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], names=names)
            done.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], names=names)

    return assembled.select("conv_id", "tokens", "loss_mask").mapInArrow(work, DIGEST)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one of control strings, formatted, tokenised and read back."""
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], ROWS)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(assemble(encode_turns(turns))).drop("n_tokens", "loss_tokens")


QUERIES = {"op5_chat_format": op5_chat_format}
_CONTROLS = r"<\\*(\|turn\|>|\|body\|>|\|end\|>|\|endoftext\|>|\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])"
ORACLES: dict[str, str] = {
    "op5_chat_format": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length('<|turn|><|body|><|end|>') + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROLS}')) + len(regexp_extract_all(text, '{_CONTROLS}')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""
}
