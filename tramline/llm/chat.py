"""Chat formatting of heterogeneous records.

A record's schema fingerprint is the hash of its nested field paths (list items
share one path). It selects a declarative mapping, which is looked for once per
fingerprint: the first mapping whose required paths are all there. A mapping names
where turns are and what roles are called; applying it gives canonical turns
(role, text), which the template turns into one string:

    <|im_start|>role\\n text <|im_end|>\\n          (without the spaces)

Inside texts and roles every ``<|`` gets a backslash between its two characters,
one more than there were, so control strings cannot be forged and taking one
backslash away restores the text. In roles, backslashes and line ends are written
as two characters. The loss mask covers assistants' texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, bounded_batches, id_in, id_out, tasks_for

START, END = "<|im_start|>", "<|im_end|>"
_FORGED, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _FORGED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Mapping:
    """``items``: path of a list of turns with ``role`` and ``text`` fields, sorted
    by ``order`` if given; or ``fields``: (role, path) in order, where an absent or
    empty optional field gives no turn and fields of one role in a row are joined
    by a blank line. ``requires``: paths that select the mapping. ``context``:
    (role, path) put before the turns if there."""

    name: str
    requires: tuple
    items: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    fields: tuple = ()
    context: tuple = ()
    roles: dict = field(default_factory=dict, hash=False)


_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Tried in this order; the first that fits is taken.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), items="messages", context=(("system", "system"),), roles=_NAMES),
    Mapping("from-value", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", context=(("system", "system"),), roles=_NAMES),
    Mapping("turns", ("turns[].role", "turns[].text"), items="turns", text="text", order="turn", roles=_NAMES),
    Mapping("turn-rows", ("rows[].role", "rows[].text"), items="rows", text="text", order="turn"),
    Mapping("instruction", ("instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt-completion", ("prompt", "completion"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt-response", ("prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question-answer", ("question", "answer"), fields=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
)


def field_paths(value, prefix: str = "") -> set:
    """Nested field paths of a parsed record; items of a list share one path."""
    if isinstance(value, dict):
        out: set = set()
        for key, inner in value.items():
            path = f"{prefix}.{key}" if prefix else str(key)
            out.add(path)
            out |= field_paths(inner, path)
        return out
    if isinstance(value, list):
        out = {prefix + "[]"}
        for inner in value:
            out |= field_paths(inner, prefix + "[]")
        return out
    return set()


def schema_fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Selector:
    """Fingerprint -> mapping, resolved once for each fingerprint."""

    def __init__(self, mappings=MAPPINGS):
        self.mappings, self.known = tuple(mappings), {}

    def select(self, paths) -> tuple:
        key = schema_fingerprint(paths)
        if key not in self.known:
            self.known[key] = next((m for m in self.mappings if set(m.requires) <= set(paths)), None)
        return key, self.known[key]


def _at(record, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _string(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(x, dict) and "text" in x for x in value):
        return "".join(_string(x["text"]) for x in value)  # a message in parts
    return json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, mapping: Mapping) -> list:
    """[(role, text)] of a parsed record."""
    turns = []
    for role, path in mapping.context:
        if text := _string(_at(record, path)):
            turns.append((role, text))
    if mapping.items is not None:
        found = [x for x in _at(record, mapping.items) or [] if isinstance(x, dict)]
        if mapping.order:
            # turns without a number keep their place before the others
            found.sort(key=lambda x: x[mapping.order] if isinstance(x.get(mapping.order), (int, float)) else float("-inf"))
        for x in found:
            role = _string(x.get(mapping.role))
            turns.append((mapping.roles.get(role.lower(), role), _string(x.get(mapping.text))))
    for role, path in mapping.fields:
        if not (text := _string(_at(record, path))) and path not in mapping.requires:
            continue
        if turns and turns[-1][0] == role:
            turns[-1] = (role, f"{turns[-1][1]}\n\n{text}")
        else:
            turns.append((role, text))
    return turns


def render(turns: list) -> tuple:
    """The formatted string and the loss mask's (start, end) in its code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        parts += (head, body, f"{END}\n")
        at += len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list:
    """[(role, text)] back from a formatted string."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not in the template's form at {at}")
    return out


FORMATTED = "formatted string, loss array<struct<start: int, end: int>>, layout string, fingerprint string"


def _row(turns: list, layout: str, key: str) -> tuple:
    text, spans = render(turns)
    return text, [{"start": a, "end": b} for a, b in spans], layout, key


def format_records(records: DataFrame, id_column: str = "id", record_column: str = "record", mappings=MAPPINGS) -> DataFrame:
    """(id, formatted, loss, layout, fingerprint) of JSON records in any layout.

    A record that is null, no JSON object, or of no known layout gives null
    formatted text and null layout, and its fingerprint where it has one. A null id
    stays null; repeated rows are kept, other columns are not read; an empty table
    gives an empty result."""
    rows = bounded_batches(records).select(id_in(f"`{id_column}`").alias("id"), F.col(f"`{record_column}`").cast("string").alias("record"))

    def run(batches):
        selector = Selector(mappings)
        for batch in batches:
            out = []
            for text in batch["record"]:
                try:
                    record = json.loads(text)
                    assert isinstance(record, dict)
                except Exception:
                    out.append((None, None, None, None))
                    continue
                key, mapping = selector.select(field_paths(record))
                out.append(_row(canonical_turns(record, mapping), mapping.name, key) if mapping else (None, None, None, key))
            made = pd.DataFrame(out, columns=["formatted", "loss", "layout", "fingerprint"])
            made.insert(0, "id", batch["id"])
            yield made

    return rows.mapInPandas(run, "id long, " + FORMATTED).withColumn("id", id_out("id"))


def format_turn_rows(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    mappings=MAPPINGS,
) -> DataFrame:
    """(id, formatted, loss, layout, fingerprint) of conversations stored a turn a row.

    A conversation's rows are put together to one nested record, {rows: [{turn, role,
    text}, ...]}, whose own field paths are hashed and select its mapping, as for any
    other record; a null turn has no field. Rows are dealt by conversation and sorted,
    and a task streams them, so it holds one conversation's turns at a time, which make
    up one output value. Null roles and texts are empty; a null turn comes first; of
    equal turns the order is by role and text; repeated rows are turns of their own;
    rows with a null id form one conversation with a null id. A record that no mapping
    fits has null formatted text. Other columns are not read; an empty table gives an
    empty result."""
    rows = bounded_batches(turns).select(
        id_in(f"`{id_column}`").alias("id"),
        id_in(f"`{turn_column}`").alias("turn"),
        F.coalesce(F.col(f"`{role_column}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition(tasks_for(turns.sparkSession), "id").sortWithinPartitions("id", "turn", "role", "text")
    columns = ["id", "formatted", "loss", "layout", "fingerprint"]

    def run(batches):
        selector, held, last, out, size = Selector(mappings), [], None, [], 0

        def close():
            record = {"rows": held}
            key, mapping = selector.select(field_paths(record))
            made = _row(canonical_turns(record, mapping), mapping.name, key) if mapping else (None, None, None, key)
            out.append((last, *made))
            return len(made[0] or "")

        for batch in batches:
            for i, turn, role, text in zip(batch["id"].tolist(), batch["turn"].tolist(), batch["role"], batch["text"]):
                if i != last:
                    if held:
                        size += close()
                    held, last = [], i
                    if size > 1 << 22 or len(out) >= 2000:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                held.append({"role": role, "text": text} if turn == NULL_ID else {"turn": turn, "role": role, "text": text})
        if held:
            close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return ordered.mapInPandas(run, "id long, " + FORMATTED).withColumn("id", id_out("id"))


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    read back from formatted strings and loss masks."""
    rows = formatted.select(id_in("id").alias("conv_id"), "formatted", "loss").where("formatted is not null")

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch["formatted"], batch["loss"]):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append(
                    (
                        len(turns),
                        hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(),
                        len(loss),
                        hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(),
                        len(text),
                    )
                )
            made = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            made.insert(0, "conv_id", batch["conv_id"].to_numpy())
            yield made

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInPandas(run, schema).withColumn("conv_id", id_out("conv_id"))
