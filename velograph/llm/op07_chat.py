r"""Chat formatting: token-level assembly of conversations.

A conversation is one sequence of ids, <s> (<|turn|> role <|text|> text <|end|>)* </s>: the reserved ids of the
template with the separately encoded roles and texts between, so no piece reaches over a border, and no text
can make a reserved id. Segment lengths give the borders by prefix sums over the conversation, and the loss mask is the
prefix sum of +1 at an assistant text's first id and -1 after its last. Control strings inside role and text are escaped: a
backslash goes after their first character, and backslashes are doubled, which is undone exactly. Reserved ids
begin after the vocabulary's last id, or where a parameter says, if the vocabulary ends before.

Turns are encoded where they are read, each on its own; only then are they brought together by conversation,
in order of turn. Ids and mask of a conversation are rows of consecutive pieces, so that one of any length costs a task
no more memory than a piece; the digests read roles, texts, the text under the mask and the length back from the
pieces alone. Equal turns of a conversation stand in order of their ids, repeated rows side by side; null
turns come first. Null roles and texts are empty. Rows without conv_id are one conversation. An empty table has no
rows. A text of any length is one turn of one piece. Bytes that are no UTF-8 are read as U+FFFD. Other columns
of the table, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common

#: The template: <s> (<|turn|> role <|text|> text <|end|>)* </s>
BOS, EOS, TURN, TEXT, END = TEMPLATE = ("<s>", "</s>", "<|turn|>", "<|text|>", "<|end|>")
#: Escaped in content: the template's strings and those that other templates give a meaning to.
CONTROL = (*TEMPLATE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
TURNS = "conv_id bigint, turn bigint, role_ids array<int>, text_ids array<int>, loss boolean"
#: first: how many ids of the conversation come before the piece.
PIECES = "conv_id bigint, first bigint, ids array<int>, mask array<boolean>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


@dataclass(frozen=True)
class Template:
    path: str | None = None
    first_reserved: int | None = None
    loss_role: str = "assistant"
    piece_turns: int = 512


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _tokenizer(data: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(data)
    found.encode_special_tokens = True
    return found


def load(how: Template = Template()) -> str:
    if how.path is None:
        import public_tokenizers

    with open(how.path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def reserved(data: str, how: Template = Template()) -> dict[str, int]:
    """The id of each string of the template, none of which the vocabulary has."""
    end = max(_tokenizer(data).get_vocab(with_added_tokens=True).values(), default=-1) + 1
    first = end if how.first_reserved is None else how.first_reserved
    if first < end:
        raise ValueError(f"reserved ids from {first} on are in the vocabulary, which ends at {end}")
    return {name: first + k for k, name in enumerate(TEMPLATE)}


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat, kind))


def format_turns(turns: DataFrame, how: Template = Template()) -> DataFrame:
    """The encoded segments of each turn, in the columns of TURNS; turns: conv_id, turn, role, text."""
    shared = turns.sparkSession.sparkContext.broadcast(load(how))

    def run(batches):
        tok = _tokenizer(shared.value)
        for batch in batches:
            for part in common.parts(batch, 3, 1 << 20):
                roles, texts = ([(x or b"").decode("utf-8", "replace") for x in common.byte_texts(part.column(c))] for c in (2, 3))
                coded = [[np.array(e.ids, np.int32) for e in tok.encode_batch(list(map(escape, x)), add_special_tokens=False)] for x in (roles, texts)]
                loss = pa.array([r == how.loss_role for r in roles], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(_lists(x, pa.int32()) for x in coded), loss], [c.split()[0] for c in TURNS.split(", ")])

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, run, TURNS)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the length of each row."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def spliced(role: np.ndarray, role_n: np.ndarray, text: np.ndarray, text_n: np.ndarray, loss: np.ndarray, new: np.ndarray, ids: dict[str, int], open_: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of some turns in a row, their loss mask, and the place of each <s>. Turns that are `new` begin a
    conversation, and end the one before, which the first turn does if one is open_."""
    ends = new.copy()
    if len(ends) and not open_:
        ends[0] = False
    one = np.ones(len(new), np.int64)
    # Segments of a turn: </s>, <s>, <|turn|>, role, <|text|>, text, <|end|>; the first two of new ones alone.
    sizes = np.stack([ends, new, one, role_n, one, text_n, one], axis=1).astype(np.int64)
    edge = np.cumsum(sizes) - sizes.reshape(-1)
    at = edge.reshape(-1, 7)
    total = int(sizes.sum())
    out, change = np.empty(total, np.int32), np.zeros(total + 1, np.int64)
    out[at[ends, 0]], out[at[new, 1]] = ids[EOS], ids[BOS]
    out[at[:, 2]], out[at[:, 4]], out[at[:, 6]] = ids[TURN], ids[TEXT], ids[END]
    for values, n, start in ((role, role_n, at[:, 3]), (text, text_n, at[:, 5])):
        out[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
    np.add.at(change, at[loss, 5], 1)
    np.add.at(change, at[loss, 6], -1)
    return out, np.cumsum(change)[:-1] > 0, at[new, 1]


def assemble(turns: DataFrame, how: Template = Template()) -> DataFrame:
    """Ids and mask of each conversation, as pieces in the columns of PIECES; those of a conversation are in
    one partition, in order. turns: as of format_turns."""
    ids = reserved(load(how), how)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        key, first = None, 0  # of the open conversation

        def pieces(keys, rows, masks):
            nonlocal first
            firsts = []
            for k, r in zip(keys, rows, strict=True):
                first = 0 if len(r) and r[0] == ids[BOS] else first
                firsts.append(first)
                first += len(r)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array(firsts, pa.int64()), _lists(rows, pa.int32()), _lists(masks, pa.bool_())], names)

        for batch in batches:
            for a in range(0, batch.num_rows, how.piece_turns):
                part = batch.slice(a, how.piece_turns)
                own = [(x,) for x in part.column(0).to_pylist()]
                new = np.array([x != y for x, y in zip(own, [key, *own], strict=False)])
                flat, mask, starts = spliced(*_flat(part.column(2)), *_flat(part.column(3)), part.column(4).to_numpy(zero_copy_only=False).astype(bool), new, ids, key is not None)
                # What stands before the first <s> goes on with the open conversation; a </s> there ends it.
                cuts = starts if key is None else np.concatenate([[0], starts])
                keys = [own[i] for i in np.flatnonzero(new)]
                keys = keys if key is None else [key, *keys]
                ends = [*cuts[1:], len(flat)]
                rows = [(k, flat[i:j], mask[i:j]) for k, i, j in zip(keys, cuts, ends, strict=True) if j > i]
                key = own[-1]
                yield pieces(*zip(*rows, strict=True))
        if key is not None:
            yield pieces([key], [np.array([ids[EOS]], np.int32)], [np.zeros(1, bool)])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")
    return common.map_arrow(ordered, run, PIECES)


class Reader:
    """Reads one conversation back from its pieces, in order."""

    def __init__(self, tok, ids: dict[str, int]):
        self.tok, self.ids, self.held, self.masked = tok, ids, np.zeros(0, np.int32), np.zeros(0, bool)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, ids: np.ndarray, mask: np.ndarray) -> bool:
        """Takes a piece; whether the conversation ends with it. Raises where the ids aren't of the template."""
        ids, mask = np.concatenate([self.held, ids]), np.concatenate([self.masked, mask])
        low, high = min(self.ids.values()), max(self.ids.values())
        marks = np.flatnonzero((ids >= low) & (ids <= high))
        names = [TEMPLATE[k] for k in (ids[marks] - low).tolist()]
        begins = 1 if names[:1] == [BOS] else 0
        ended = names[-1:] == [EOS]
        inner = marks[begins : len(marks) - ended]
        whole = len(inner) // 3
        if names[begins : begins + 3 * whole] != [TURN, TEXT, END] * whole or (begins and self.n_turns) or ended and len(inner) % 3:
            raise ValueError("ids that aren't of the template")
        turn, text, end = inner[: 3 * whole].reshape(-1, 3).T
        runs = [x for t, x, e in zip(turn.tolist(), text.tolist(), end.tolist(), strict=True) for x in (ids[t + 1 : x].tolist(), ids[x + 1 : e].tolist())]
        # Of the mask alone: its runs of ids, wherever they lie.
        stop = int(end[-1]) + 1 if whole else 0
        step = np.diff(np.concatenate([[0], mask[:stop].astype(np.int8), [0]]))
        under = [ids[i:j].tolist() for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
        said = self.tok.decode_batch(runs + under, skip_special_tokens=False) if runs else []
        plain = [unescape(s) if "\\" in s else s for s in said]
        self.turns.update("".join(f"{x}\n" for x in plain[: len(runs)]).encode())
        for x in plain[len(runs) :]:
            self.loss.update(x.encode())
            self.loss_chars += len(x)
        self.n_turns += whole
        self.formatted_chars += sum(map(len, said[: len(runs)])) + whole * (len(TURN) + len(TEXT) + len(END)) + begins * len(BOS) + ended * len(EOS)
        done = max(stop, int(marks[0]) + 1 if begins else 0)
        self.held, self.masked = ids[done:], mask[done:]
        return ended

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def digests(pieces: DataFrame, how: Template = Template(), ordered: bool = False) -> DataFrame:
    """A row for each conversation, read back from its pieces, in the columns of DIGEST; ordered: the pieces lie
    as assemble leaves them."""
    shared, ids = pieces.sparkSession.sparkContext.broadcast(load(how)), reserved(load(how), how)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches):
        tok, reader = _tokenizer(shared.value), None
        for batch in batches:
            done = []
            flat, sizes = _flat(batch.column(2))
            masks, _ = _flat(batch.column(3))
            stop = np.cumsum(sizes)
            for conv, a, b in zip(batch.column(0).to_pylist(), (stop - sizes).tolist(), stop.tolist(), strict=True):
                reader = reader or Reader(tok, ids)
                if reader.add(flat[a:b], masks[a:b].astype(bool)):
                    done.append((conv, *reader.row()))
                    reader = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
        if reader is not None:
            raise ValueError("a conversation without an end")

    if not ordered:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return common.map_arrow(pieces.select("conv_id", "first", "ids", "mask"), run, DIGEST)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(assemble(format_turns(turns.unionByName(extra))), ordered=True)


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    found = q("|".join(re.sub(r"([\[\]|/.])", r"\\\1", c) for c in CONTROL))
    length = lambda x: f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, {found})))"
    fixed = sum(map(len, (TURN, TEXT, END)))
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum({length('role')} + {length('text')} + {fixed}) + {len(BOS) + len(EOS)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


ORACLE_SQL = _oracle()
