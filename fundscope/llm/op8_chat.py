"""Chat formatting by schema fingerprints.

A record is a JSON text in one of many layouts: a list of messages, a prompt with a
response, an instruction with input and output, a single turn.  Its fingerprint is a hash
of the sorted set of its nested field paths (array elements share one path).  The fingerprint
selects a declarative mapping, a list of (role, path) rules, that turns the record into
canonical (role, text) turns.  Mappings are data: ``MAPPINGS`` can be extended by the caller, and a
record whose fingerprint no mapping has is returned with ``mapping`` null instead of being
dropped.

Turns are formatted one by one, so no conversation is gathered in a row: each output row
is one turn's piece of its conversation's text, in order.  A piece is

    <|turn|>role<|text|>escaped text<|end|>

and the loss mask of an assistant piece is the span of its escaped text.  Escaping puts
a backslash before every backslash and before every ``<|``, ``[``, ``]``, ``<s>``, ``</s>`` opening, so control
strings of this and other templates inside texts cannot be mistaken, and ``unescape`` restores the
text exactly.

``read_back`` parses pieces in order, streaming over each conversation with running hashes: memory
does not depend on a conversation's length.

Nulls: a null text is empty, a null role is the empty role, a null conversation id is a
conversation of its own; null turns come last.  Equal turn numbers are ordered by role and
text; repeated rows are kept.  Records that are null, not JSON or empty give no turns.
Empty input gives no rows.  Extra fields of records change the fingerprint, except those a mapping
declares as ignored; extra columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

NAME = "op8_chat_format"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"\\|<(?=\||s>|/s>)|[\[\]]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PIECE = re.compile(re.escape(TURN) + r"((?:[^\\<]|\\.|<(?!\|))*)" + re.escape(TEXT) + r"((?:[^\\<]|\\.|<(?!\|))*)" + re.escape(END), re.S)


@dataclass(frozen=True)
class Mapping:
    """How records of one layout become turns.

    ``paths``: the layout's field paths; ``turns``: rules in order.  A rule is (role, text path), or
    (role path, text path) with a role that begins with ``$``.  Paths through ``[]`` give a turn per
    element.  ``join``: text paths joined by a blank line with ``+``; absent or empty parts are
    skipped.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


MAPPINGS = (
    Mapping("turn", ("role", "text"), (("$role", "text"),), roles=()),
    Mapping("messages", ("messages[].content", "messages[].role"), (("$messages[].role", "messages[].content"),)),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), (("$conversations[].from", "conversations[].value"),)),
    Mapping("prompt", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("input", "instruction", "output"), (("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction-output", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("system-prompt", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves; elements of an array share the path of the array with ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, prefix + "[]")} or {prefix + "[]"}
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _at(value, path: str) -> list:
    """All values of a path."""
    for step in path.split("."):
        many = step.endswith("[]")
        step = step.removesuffix("[]")
        value = [x.get(step) for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
        if many:
            value = [y for x in value for y in (x or [])]
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: str | None, known: dict[str, Mapping]) -> tuple[str, str | None, list[tuple[str, str]]]:
    """Fingerprint, name of the mapping (null: none), canonical turns."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    mark = fingerprint(field_paths(value)) if isinstance(value, dict) else ""
    mapping = known.get(mark)
    if mapping is None:
        return mark, None, []
    rename, out = dict(mapping.roles), []
    for role, path in mapping.turns:
        parts = [[_text(v) for v in _at(value, p)] for p in path.split("+")]
        texts = parts[0] if len(parts) == 1 else ["\n\n".join(p[0] for p in parts if p and p[0])]
        roles = [_text(r) for r in _at(value, role[1:])] if role.startswith("$") else [role] * len(texts)
        out += [(rename.get(r, r), t) for r, t in zip(roles, texts)]
    return mark, mapping.name, out


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The piece, and the span of it that the loss covers (empty unless the assistant speaks)."""
    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
    return head + body + END, len(head), len(head) + len(body) if role == "assistant" else len(head)


PIECES = "conv_id long, turn long, place int, mapping string, fingerprint string, piece string, loss_from int, loss_to int"


def _format(mappings: tuple[Mapping, ...]):
    known = {fingerprint(m.paths): m for m in mappings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns)):
                mark, name, turns = turns_of(record, known)
                rows += [(conv, turn, i, name, mark, *format_turn(r, t)) for i, (r, t) in enumerate(turns)]
                if name is None:
                    rows.append((conv, turn, 0, None, mark, None, None, None))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = ["conv_id", "turn", "place", "mapping", "fingerprint", "piece", "loss_from", "loss_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    return run


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, record) -> one row per turn with its formatted ``piece`` and loss span.

    A conversation's text is its pieces joined in the order of (turn, place, piece).
    """
    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(_format(mappings), PIECES)


def parse_piece(piece: str, loss_from: int, loss_to: int) -> tuple[str, str, str]:
    """Role, text and text under the loss mask, read from a formatted piece."""
    m = _PIECE.fullmatch(piece)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m.group(1)), unescape(m.group(2)), unescape(piece[loss_from:loss_to])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come one after another; the last may go on in the next batch."""
    state = None

    def fresh(conv):
        return [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def emit(done):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = [[x.hexdigest() if i in (2, 4) else x for x in col] for i, col in enumerate(zip(*done))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in slices(batches):
        done = []
        for conv, piece, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(state)
                state = fresh(conv)
            role, text, loss = parse_piece(piece, a, b)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[3] += len(loss)
            state[4].update(loss.encode("utf-8", "surrogatepass"))
            state[5] += len(piece)
        if done:
            yield emit(done)
    if state is not None:
        yield emit([state])


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its pieces in order."""
    rows = pieces.filter(F.col("piece").isNotNull()).withColumn("_last", F.col("turn").isNull())
    # one role and text after another: equal turns in the order of what the pieces say
    role = F.split_part("piece", F.lit(TEXT), F.lit(1))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_last", "turn", "place", role, "piece")
    return ordered.select("conv_id", "piece", "loss_from", "loss_to").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """A table of turns as records of the layout ``{"role", "text"}``."""
    empty = F.lit("")
    record = F.to_json(F.struct(F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))
    return conversations.select("conv_id", "turn", record.alias("record"))


#: A conversation made of control strings of common templates; it takes part in the query.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_records(table(spark, sf_dir, "conversations"))
    said = json.dumps({"messages": [{"role": r, "content": CONTROL_TEXT} for r in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(said).alias("record"))
    return read_back(format_records(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").unionByName(extra)))


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(text) + len(regexp_replace(regexp_replace(regexp_replace(text, '<([|]|s>|/s>)', '<<\\1', 'g'),
    '[\\\\]', '\\\\\\\\', 'g'), '([\\[\\]])', '\\\\\\1', 'g')) - len(text)
  + len(role) + 8 + 8 + 7 AS piece FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(piece)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
