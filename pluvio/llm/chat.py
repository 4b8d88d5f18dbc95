"""Chat formatting: schema fingerprints choose the mapping that turns a record into canonical turns.

A record is a JSON object. The paths of its non-null leaves (list positions left out) are its layout; the hash of the sorted paths that
a mapping knows is its fingerprint for that mapping, and each mapping is registered under the fingerprints of its layouts. So
other fields, such as ids, scores or those of another mapping, do not disturb a record. Where several mappings find their
layout, a list of messages goes before single fields, then the one with more of the record's paths, then the earlier one.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns: `each` names a list of messages (None: the record is one), else fields give turns.

    `turns` holds (role, fields): a role that starts with `@` is read from that field; the text is the fields' texts, joined by an empty line.
    `needs` are the paths that must be there, `may` those that can be absent.
    """
    name: str
    each: str | None
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    needs: frozenset[str]
    may: frozenset[str] = frozenset()
    first: str | None = None  # field of the record with the system's text, before the list of messages


ROW = "message_row"  # marks a record made of a table's row, whose role and text may both be null


def _messages(name: str, each: str | None, role: str, text: str) -> Mapping:
    prefix = f"{each}[]." if each else ""
    return Mapping(name, each, ((f"@{role}", (text,)),), frozenset({prefix + role if each else ROW}),
                   frozenset({prefix + text, "system" if each else role}), "system" if each else None)


def _fields(name: str, turns, needs, may=()) -> Mapping:
    return Mapping(name, None, tuple(turns), frozenset(needs), frozenset(may))


MAPPINGS = (
    _messages("message rows", None, "role", "text"),
    _messages("role and content", "messages", "role", "content"),
    _messages("from and value", "conversations", "from", "value"),
    _messages("role and text", "turns", "role", "text"),
    _fields("prompt and response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), {"prompt", "response"}, {"system"}),
    _fields("prompt and completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), {"prompt", "completion"}, {"system"}),
    _fields("question and answer", (("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), {"question", "answer"}, {"context"}),
    _fields("instruction and output", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), {"instruction", "output"}, {"system", "input"}),
    _fields("instruction and response", (("user", ("instruction", "context")), ("assistant", ("response",))), {"instruction", "response"}, {"context"}),
    _fields("question and response", (("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",))), {"question", "response"}, {"system_prompt"}),
)


def paths(value, prefix: str = "") -> set[str]:
    """Paths of all non-null leaves of a parsed record; a list adds [] to its path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, prefix + "[]") for v in value))
    return set() if value is None else {prefix}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    """Every layout of every mapping by fingerprint; optional paths may be there or not."""
    out = {}
    for m in mappings:
        may = sorted(m.may)
        for n in range(len(may) + 1):
            for some in combinations(may, n):
                layout = fingerprint(set(m.needs) | set(some))
                if layout in out:
                    raise ValueError(f"{m.name} and {out[layout].name} have the same layout")
                out[layout] = m
    return out


def _chooser(mappings=MAPPINGS):
    """A function from the paths of a record to its mapping, or None; the last layouts are remembered."""
    known = registry(mappings)

    @lru_cache(1 << 12)
    def choose(found: frozenset[str]) -> Mapping | None:
        fits = [m for m in mappings if known.get(fingerprint(found & (m.needs | m.may))) is m]
        return max(fits, key=lambda m: (m.each is not None, len(found & (m.needs | m.may))), default=None)
    return choose


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    out = [("system", _text(record[mapping.first]))] if mapping.first and record.get(mapping.first) is not None else []
    for message in [record] if mapping.each is None else record[mapping.each]:
        if not isinstance(message, dict):
            continue
        for role, fields in mapping.turns:
            given = [_text(message.get(f)) for f in fields if message.get(f) is not None]
            if role[0] == "@":
                name = _text(message.get(role[1:]))
                out.append((ROLES.get(name, name) if mapping.each else name, "\n\n".join(given)))
            elif given:
                out.append((role, "\n\n".join(given)))
    return out


def escape(text: str) -> str:
    """No `<|` is left in a text; a backslash before a character takes it literally."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _role_out(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


START, END = "<|im_start|>", "<|im_end|>"


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its loss mask begins and ends: the text of assistant turns, else nothing."""
    head, body = f"{START}{_role_out(role)}\n", escape(text)
    lost = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *lost


_TURN = re.compile(re.escape(START) + r"((?:(?!<\|)[^\n])*)\n((?:(?!<\|).)*)" + re.escape(END) + "\n", re.S)


def _format(batches):
    choose = _chooser()
    for batch in batches:
        out = {c: [] for c in ("conv_id", "turn", "nth", "layout", "segment", "loss_start", "loss_end")}
        for conv_id, turn, raw in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "record"))):
            try:
                record = json.loads(raw, strict=False) if raw else {}
            except ValueError:
                record = None
            mapping = choose(frozenset(paths(record))) if isinstance(record, dict) else None
            turns = turns_of(record, mapping) if mapping else []
            for nth, (role, text) in enumerate(turns):
                row = (conv_id, turn, nth, mapping.name, *render(role, text))
                for c, v in zip(out, row):
                    out[c].append(v)
            if not turns:
                for c, v in zip(out, (conv_id, turn, 0, mapping.name if mapping else None, "", 0, 0)):
                    out[c].append(v)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def format_chats(records: DataFrame) -> DataFrame:
    """conv_id, turn, nth, layout, segment, loss_start, loss_end from `records` (conv_id, turn, record: JSON text).

    One row per turn; the formatted conversation is its segments in the order of turn and nth. The loss mask is
    [loss_start, loss_end) of a segment, in code points. No grouping takes place, so a conversation may have any length. Records
    that no mapping fits, or that are not JSON objects, give one empty segment with a null layout: nothing is lost
    unseen. A null record is an empty one. Null ids and turns are kept and sort first.
    """
    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "record")
    return arrow_map(rows, _format, "conv_id long, turn long, nth int, layout string, segment string, loss_start int, loss_end int")


def message_records(rows: DataFrame) -> DataFrame:
    """Records of rows (conv_id, turn, role, text); the fields that are null stay out of the record."""
    return rows.select("conv_id", "turn", F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
                                                           F.lit(True).alias(ROW))).alias("record"))


def _read_back(batches):
    """Parses each conversation from its segments, one after another; holds a turn at a time."""
    state, out = None, []

    def close():
        if state["rest"]:
            raise ValueError(f"conversation {state['id']} can't be read back")
        out.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    def flush():
        rows, out[:] = list(out), []
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        for conv_id, segment, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
            if state is None or state["id"] != conv_id:
                if state is not None:
                    close()
                state = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "rest": ""}
            state["chars"] += len(segment)
            lost = unescape(segment[start:end])
            state["loss_chars"] += len(lost)
            state["loss"].update(lost.encode("utf-8", "replace"))
            line, at = state["rest"] + segment, 0
            while m := _TURN.match(line, at):
                state["n"] += 1
                state["turns"].update(f"{_role_in(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "replace"))
                at = m.end()
            state["rest"] = line[at:]
        if out:
            yield flush()
    if state is not None:
        close()
    if out:
        yield flush()


def digests(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted segments.

    A hash over a conversation has to see it in order; it is read as a sorted stream, never held as a group. Equal places are
    ordered by their segments.
    """
    parts = segments.select("conv_id", "turn", "nth", "segment", "loss_start", "loss_end").repartition("conv_id")
    ordered = parts.sortWithinPartitions("conv_id", "turn", "nth", "segment")
    return arrow_map(ordered.select("conv_id", "segment", "loss_start", "loss_end"), _read_back,
                     "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
