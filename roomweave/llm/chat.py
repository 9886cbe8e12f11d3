r"""Chat formatting: records of many layouts to canonical turns, turns to training text with a loss mask, and back.

A record is a JSON string.  Its nested field paths (arrays as []) are hashed, and the hash selects a declarative
mapping; a record with a layout of no mapping gives no turns (null) and keeps its fingerprint, so it can be counted.

Training text: each turn is "### ", its role, ":\n", its text, "</turn>\n".  Within role and text, a backslash goes
before every backslash, "###" and "</turn>", and in a role also before ":", so texts cannot end or open a turn;
reading back drops one backslash of each.  The mask holds the places of the texts of assistant turns, without marks.

Null roles and texts count as empty.  A conversation without turns is the empty text.  Other columns stay, but for those
of the new names, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
TURNS_DDL = "array<struct<role:string,text:string>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
OPEN, CLOSE = "### ", "</turn>"

#: name -> (field paths that occur, field paths that may, turns). A turn is (role, path) or, for a list,
#: (path of the list, field of the role, field of the text).
MAPPINGS = {
    "messages": ({"messages[].content", "messages[].role"}, set(), [("messages", "role", "content")]),
    "conversations": ({"conversations[].from", "conversations[].value"}, {"id", "system"}, [("system", "system"), ("conversations", "from", "value")]),
    "prompt_completion": ({"completion", "prompt"}, set(), [("user", "prompt"), ("assistant", "completion")]),
    "prompt_response": ({"prompt", "response"}, {"system"}, [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "instruction": ({"instruction", "output"}, {"input"}, [("user", "instruction", "input"), ("assistant", "output")]),
    "question_answer": ({"answer", "question"}, {"context"}, [("user", "context", "question"), ("assistant", "answer")]),
    "data_prompt": ({"data.completion", "data.prompt"}, set(), [("user", "data.prompt"), ("assistant", "data.completion")]),
}
#: Roles of the layout with "from"; the others hold roles as they are to be.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LISTS = {"messages", "conversations"}


def field_paths(value, path: str = "") -> set[str]:
    """The paths of all leaves."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items())) if value else {path}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{path}[]") for v in value)) if value else {f"{path}[]"}
    return {path}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _selected() -> dict[str, list[tuple]]:
    """Each fingerprint that a mapping accepts -> its turns."""
    table = {}
    for must, may, turns in MAPPINGS.values():
        may = sorted(may)
        for bits in range(1 << len(may)):
            table[fingerprint(must | {p for i, p in enumerate(may) if bits >> i & 1})] = turns
        for path in (t[0] for t in turns if t[0] in LISTS):
            table.setdefault(fingerprint({f"{path}[]"}), turns)  # an empty list
    return table


def _at(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _turns(record, spec: list[tuple]) -> list[dict]:
    out = []
    for head, *paths in spec:
        if head in LISTS:
            for item in _at(record, head) or []:
                role = _text(_at(item, paths[0]))
                out.append({"role": ROLES.get(role, role) if paths[0] == "from" else role, "text": _text(_at(item, paths[1]))})
        elif any(_at(record, p) is not None for p in paths) or head != "system":
            out.append({"role": head, "text": "\n\n".join(x for x in (_text(_at(record, p)) for p in paths) if x)})
    return out


def _mapped(df: DataFrame, column: str, new: list[tuple[str, pa.DataType, str]], work) -> DataFrame:
    """df with the columns ``new``, which work() makes of each value of ``column``."""
    df = df.drop(*(name for name, _, _ in new if name != column))
    kept = [c for c in df.columns if c not in {name for name, _, _ in new}]
    schema = df.select(*kept, *(F.lit(None).cast(ddl).alias(name) for name, _, ddl in new)).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = list(zip(*map(work, part.column(column).to_pylist())))
                arrays = [pa.array(v, type=t) for v, (_, t, _) in zip(made, new)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], names=[*kept, *(n for n, _, _ in new)])

    return df.mapInArrow(run, schema)


def to_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """records with layout (the fingerprint; null if the JSON cannot be read) and turns."""
    table = _selected()

    def work(value):
        try:
            parsed = json.loads(value)
        except (TypeError, ValueError):
            return None, None
        layout = fingerprint(field_paths(parsed))
        return layout, _turns(parsed, table[layout]) if layout in table else None

    return _mapped(records, record, [("layout", pa.string(), "string"), ("turns", pa.list_(TURN), TURNS_DDL)], work)


_CONTROL, _CONTROL_ROLE, _ESCAPED = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:"), re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"\\.|:\n|</turn>", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_one(turns: list[dict] | None) -> tuple[str, list[dict]]:
    parts, at, mask = [], 0, []
    for turn in turns or []:
        head, body = f"{OPEN}{escape(turn['role'] or '', _CONTROL_ROLE)}:\n", escape(turn["text"] or "")
        if turn["role"] == "assistant":
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), mask


def parse_one(formatted: str | None) -> list[dict]:
    turns, at, role = [], 0, None
    for m in _MARK.finditer(formatted or ""):
        if role is None and m.group() == ":\n":
            role, at = unescape(formatted[at + len(OPEN) : m.start()]), m.end()
        elif role is not None and m.group() == CLOSE:
            turns.append({"role": role, "text": unescape(formatted[at : m.start()])})
            role, at = None, m.end() + 1
    return turns


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with formatted (the training text) and loss_mask (array of start, end)."""
    return _mapped(df, turns, [("formatted", pa.string(), "string"), ("loss_mask", pa.list_(SPAN), "array<struct<start:bigint,end:bigint>>")], format_one)


def read_back(df: DataFrame, formatted: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """df with turns_back and loss_text (the text under the mask, unescaped), read from the training text."""
    both = df.select("*", F.struct(F.col(formatted).alias("f"), F.col(mask).alias("m")).alias("_both"))

    def work(value):
        text = value["f"] or ""
        return parse_one(text), "".join(unescape(text[s["start"] : s["end"]]) for s in value["m"] or [])

    return _mapped(both, "_both", [("turns_back", pa.list_(TURN), TURNS_DDL), ("loss_text", pa.string(), "string")], work).drop("_both")
