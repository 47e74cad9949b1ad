"""Chat formatting by prefix trees.

Conversations are sorted by the chain of their turns' hashes, so those that share initial turns stand together, and
consecutive ones are merged into prefix trees: a turn that the last conversation had at the same place, after the same
turns, is not written again. Sorted order is depth-first order, so the text of a tree is its nodes' turns one after the
other, each once. A node has its place in that text, the position ids of its characters (those of a conversation that
is read alone) and the intervals that its characters attend to: its ancestors, which neighbours in the text join.

A pack is a tree of bounded length: what no longer fits starts the next one, with its own initial turns. So a first
turn that a third of all conversations share is one node of every pack that holds some of them, and packs are made by
many tasks. The token is the character; `segments` carry all that another tokeniser needs to cut its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

PACK = 65_536  # characters of a pack, unless one conversation is longer
MEMBERS = 4_096  # conversations of a pack: copies add none to its text
STEP = 256  # rows that become Python objects at once
#: Marks of the template. A text that holds one, with or without backslashes after its first character, gets one more.
CONTROL = r"(?:/?s>|/?INST\]|/?ROLE\]|ASST\])"
_WRITE = re.compile(rf"([<\[])(\\*{CONTROL})")
_READ = re.compile(rf"([<\[])\\(\\*{CONTROL})")
PACKS = """pack string, text string, segments array<struct<start:int,length:int,position:int,parent:int,attends:array<struct<start:int,end:int>>,loss:struct<start:int,end:int>>>, members array<struct<conv_id:bigint,segment:int>>"""


def escape(text: str) -> str:
    return _WRITE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _READ.sub(r"\1\2", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn under the template, and start and end of what counts for the loss: an assistant's text."""
    body = escape(text or "")
    if role == "assistant":
        head = "<s>[ASST] "
        return f"{head}{body}</s>", len(head), len(head) + len(body)
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 0, 0
    return f"<s>[ROLE] {escape(role or '')} [/ROLE] {body}</s>", 0, 0


_ROLE = re.compile(r"\[ROLE\] (.*?) \[/ROLE\] (.*)</s>", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn: the inverse of format_turn."""
    out = []
    for turn in formatted.split("<s>")[1:]:
        if turn.startswith("[ASST] "):
            out.append(("assistant", unescape(turn[7:-4])))
        elif turn.startswith("[INST] "):
            out.append(("user", unescape(turn[7:-8])))
        else:
            role, body = _ROLE.fullmatch(turn).groups()
            out.append((unescape(role), unescape(body)))
    return out


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, path (a hash of each turn and all before it), turns (formatted, with the bounds of the loss), in order of
    turn. Rows of equal or null turn go by role and text, nulls first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, path, chain, rows, size = None, [], [], None, [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for b in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            for c, role, text in zip(*(b[n].to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if chain is None or c != conv:
                    if chain is not None:
                        rows.append((conv, b"".join(path), held))
                    conv, held, path, chain = c, [], [], hashlib.sha256()
                if size > 4_000_000 and rows:
                    yield batch()
                    rows, size = [], 0
                turn, start, end = format_turn(role, text)
                held.append({"text": turn, "start": start, "end": end})
                size += len(turn)
                # `<s>` begins a turn and stands nowhere else, so the chain of formatted turns tells them apart.
                chain.update(turn.encode("utf-8", "surrogatepass"))
                path.append(chain.digest()[:8])
        if chain is not None:
            rows.append((conv, b"".join(path), held))
        yield batch()

    ddl = StructType.fromDDL("conv_id long, path binary, turns array<struct<text:string,start:int,end:int>>")
    schema = to_arrow_schema(ddl)
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, ddl)


@dataclass
class Pack:
    """A prefix tree under construction: the path of the last conversation, and all written so far."""

    text: list[str] = field(default_factory=list)
    length: int = 0
    segments: list[dict] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    path: list[tuple[str, int, int]] = field(default_factory=list)  # (turn, segment, position after it)

    def shared(self, turns: list[dict]) -> int:
        """How many initial turns are those of the last conversation."""
        n = 0
        for (text, _, _), turn in zip(self.path, turns, strict=False):
            if text != turn["text"]:
                break
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[dict], shared: int) -> None:
        del self.path[shared:]
        for turn in turns[shared:]:
            parent, position = (self.path[-1][1], self.path[-1][2]) if self.path else (-1, 0)
            over = self.segments[parent] if self.path else None
            attends = [] if over is None else joined(over["attends"], over["start"], over["start"] + over["length"])
            n = len(turn["text"])
            loss = {"start": self.length + turn["start"], "end": self.length + turn["end"]}
            self.segments.append({"start": self.length, "length": n, "position": position, "parent": parent, "attends": attends, "loss": loss})
            self.text.append(turn["text"])
            self.length += n
            self.path.append((turn["text"], len(self.segments) - 1, position + n))
        self.members.append({"conv_id": conv_id, "segment": self.path[-1][1]})

    def row(self) -> tuple:
        text = "".join(self.text)
        name = hashlib.sha256(f"{self.members[0]['conv_id']} {text}".encode("utf-8", "surrogatepass")).hexdigest()
        return name, text, self.segments, self.members


def joined(intervals: list[dict], start: int, end: int) -> list[dict]:
    if intervals and intervals[-1]["end"] == start:
        return [*intervals[:-1], {"start": intervals[-1]["start"], "end": end}]
    return [*intervals, {"start": start, "end": end}]


def packs(turns: DataFrame, length: int = PACK, members: int = MEMBERS) -> DataFrame:
    """pack, text, segments, members: prefix trees of conversations (conv_id, turn, role, text), depth-first.

    A segment is a turn: its start and length in the pack's text, the position id of its first character (the others
    follow), its parent, the intervals before it that it attends to, and the interval that counts for the loss. A member
    is a conversation and the segment where it ends. Every conversation is a member once, copies of one text too. A
    conversation must fit a row, as one longer than a pack makes a pack of its own.

    Null texts and roles are empty, null conv_ids are one conversation; repeated rows stay as turns; an empty table gives
    no packs. Other columns are left aside.
    """
    schema = to_arrow_schema(StructType.fromDDL(PACKS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda p: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(p.row(), schema.types, strict=True)], schema=schema)
        p = Pack()
        for b in batches:
            for r in (r for i in range(0, b.num_rows, STEP) for r in b.select(["conv_id", "turns"]).slice(i, STEP).to_pylist()):
                shared = p.shared(r["turns"])
                if p.members and (len(p.members) >= members or p.length + sum(len(t["text"]) for t in r["turns"][shared:]) > length):
                    yield batch(p)
                    p, shared = Pack(), 0
                p.add(r["conv_id"], r["turns"], shared)
        if p.members:
            yield batch(p)

    convs = formatted_conversations(turns)
    return convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(build, PACKS)


def read_packs(packed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each member, from the packs alone: a
    conversation is what its last segment attends to, and that segment."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def read(text: str, segments: list[dict], last: int) -> tuple:
        s = segments[last]
        spans = [(x["start"], x["end"]) for x in joined(s["attends"], s["start"], s["start"] + s["length"])]
        formatted = "".join(text[a:z] for a, z in spans)
        turns = read_turns(formatted)
        loss = []
        while last >= 0:
            loss.append(unescape(text[segments[last]["loss"]["start"] : segments[last]["loss"]["end"]]))
            last = segments[last]["parent"]
        learned = "".join(reversed(loss))
        digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), len(formatted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, segments, members in zip(*(b[c].to_pylist() for c in ("text", "segments", "members")), strict=True):
                seen = {m: read(text, segments, m) for m in {m["segment"] for m in members}}
                columns = zip(*[(m["conv_id"], *seen[m["segment"]]) for m in members], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return packed.mapInArrow(run, ddl)


def with_control(turns: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts are made of the template's own marks."""
    marks = turns.sparkSession.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(marks)


def op13_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packs(packs(with_control(table(spark, sf_dir, "conversations"))))


SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*{CONTROL})', '\1\\\2', 'g') AS body, regexp_replace(role, '([<\[])(\\*{CONTROL})', '\1\\\2', 'g') AS name FROM c),
f AS (SELECT *, CASE role WHEN 'assistant' THEN '<s>[ASST] ' || body || '</s>' WHEN 'user' THEN '<s>[INST] ' || body || ' [/INST]'
  ELSE '<s>[ROLE] ' || name || ' [/ROLE] ' || body || '</s>' END AS formatted FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
