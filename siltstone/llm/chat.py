"""Chat formatting (1): schema fingerprints select declarative mappings to canonical turns.

A record's layout is the set of its nested field paths (``messages[].content[].text``); the fingerprint is a digest of
the sorted paths. ``LAYOUTS`` declares, for each known layout, where turns come from: ``turns`` names an array and the
fields of role and text in its elements, ``fields`` lists (role, path) pairs of single fields in order; all are paths,
whose steps are parted by dots. Optional fields and extra ones make layouts of their own, so a layout is looked up first
by its fingerprint and, if that is unknown, by the one mapping whose required paths the record has. A text given as
a list of parts is the parts' texts, one to a line.

Template: each turn is ``<turn role>`` and a line end, the escaped text, ``</turn>`` and a line end. Escaping doubles
every backslash and writes ``\\l`` for the ``<`` of anything that looks like a turn's mark, so no control string
survives inside a text and unescaping gives every text back. The loss mask is the spans, in code points
of the formatted text, of the escaped assistant texts.

Defined results: null roles and texts count as empty; turns are ordered by turn (null first), then role and text,
and repeated rows are turns each; rows with a null conversation id are one conversation; a record that no
mapping fits has a null layout and no turns; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of roles that mappings with ``roles`` put into canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Mappings by name. ``turns``: array path, role path, text path. ``fields``: (role, path), in order.
LAYOUTS: dict[str, dict] = {
    "messages": {"turns": ("messages", "role", "content")},
    "rows": {"turns": ("turns", "role", "text")},
    "shares": {"turns": ("conversations", "from", "value"), "roles": ROLES},
    "authored": {"turns": ("conversation.messages", "author.role", "content.parts"), "roles": ROLES},
    "prompt_completion": {"fields": [("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"fields": [("user", "prompt"), ("assistant", "response")]},
    "instruction": {"fields": [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")], "optional": ["system", "input"]},
    "input_output": {"fields": [("system", "input.system"), ("user", "input.prompt"), ("assistant", "output.text")], "optional": ["input.system"]},
    "question": {"fields": [("user", "question"), ("assistant", "answer")]},
}
_MARK = re.compile(r"<(?=/?turn)")
_TURN = re.compile(r"<turn ((?:[^>\\]|\\.)*)>\n(.*?)</turn>\n", re.S)


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a parsed record; array elements share the path ``[]``."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {f"{at}:object"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(value) -> str:
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


def _required(mapping: dict) -> set[str]:
    if "turns" in mapping:
        array, role, text = mapping["turns"]
        return {f"{array}[].{role}", f"{array}[].{text}"}
    return {p for _, p in mapping["fields"] if p not in mapping.get("optional", ())}


def known_fingerprints(layouts: dict[str, dict] = LAYOUTS) -> dict[str, str]:
    """Fingerprints of the records that have a mapping's required paths and no others."""
    return {hashlib.sha256("\n".join(sorted(_required(m))).encode()).hexdigest()[:16]: name for name, m in layouts.items()}


def _has(have: set[str], required: str) -> bool:
    """Whether a path is there, as a leaf or with something below it."""
    return required in have or any(p.startswith((f"{required}[]", f"{required}.")) for p in have)


def select_layout(value, known: dict[str, str], layouts: dict[str, dict] = LAYOUTS, most: int = 10_000) -> str | None:
    """By fingerprint; else the fitting mapping with the most required paths, the first of equals. Up to ``most`` found ones are remembered."""
    mark = fingerprint(value)
    if mark not in known:
        have = paths(value)
        fitting = [n for n, m in layouts.items() if all(_has(have, p) for p in _required(m))]
        found = max(fitting, key=lambda n: len(_required(layouts[n])), default=None)
        if len(known) >= most:
            return found
        known[mark] = found
    return known[mark]


def _at(value, path: str):
    """What stands at a path; null where a step is missing."""
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _string(x) -> str:
    if isinstance(x, list):
        return "\n".join(_string(p["text"] if isinstance(p, dict) and isinstance(p.get("text"), str) else p) for p in x)
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def canonical_turns(value, layout: str | None, layouts: dict[str, dict] = LAYOUTS) -> list[tuple[str, str]]:
    """(role, text) of a parsed record by its mapping."""
    if layout is None:
        return []
    mapping = layouts[layout]
    if "turns" in mapping:
        array, role, text = mapping["turns"]
        turns = _at(value, array)
        found = [(_string(_at(t, role)), _string(_at(t, text))) for t in (turns if isinstance(turns, list) else []) if isinstance(t, dict)]
        return [(mapping.get("roles", {}).get(r, r), t) for r, t in found]
    said = [(r, p, _at(value, p)) for r, p in mapping["fields"]]
    return [(r, _string(x)) for r, p, x in said if x not in (None, "") or p not in mapping.get("optional", ())]


def escape(text: str) -> str:
    return _MARK.sub(r"\\l", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">", "n": "\n"}.get(m[1], m[1]), text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        name = escape(role).replace(">", "\\g").replace("\n", "\\n")
        head, body = f"<turn {name}>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chats(records: DataFrame, record: str = "record", key: str = "conv_id", layouts: dict[str, dict] = LAYOUTS) -> DataFrame:
    """The key, the layout's name and fingerprint, ``formatted`` and ``loss_spans`` of JSON records."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = dict(known_fingerprints(layouts))
        for pdf in parts:
            rows = []
            for raw in pdf["_record"]:
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    value = None
                value = value if isinstance(value, dict) else {}
                layout = select_layout(value, known, layouts)
                formatted, spans = format_turns(canonical_turns(value, layout, layouts))
                rows.append((layout, fingerprint(value), formatted, [list(s) for s in spans]))
            yield pd.concat([pdf[["_key"]], pd.DataFrame(rows, columns=["layout", "fingerprint", "formatted", "loss_spans"], index=pdf.index)], axis=1)

    shaped = records.select(F.col(key).alias("_key"), F.col(record).alias("_record"))
    kind = shaped.schema["_key"].dataType.simpleString()
    return shaped.mapInPandas(run, f"_key {kind}, layout string, fingerprint string, formatted string, loss_spans array<array<int>>").withColumnRenamed("_key", key)


def chat_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record for each conversation from rows of turns; a conversation is one row of the result anyway."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("_t"))
    turns = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", F.to_json(F.struct(turns.alias("turns"))).alias("record"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The columns of query op1, read back from the formatted texts and their loss masks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text, spans in zip(pdf["formatted"], pdf["loss_spans"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                joined = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((len(turns), sha(joined), len(loss), sha(loss), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.concat([pdf[["conv_id", "layout", "fingerprint"]], pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInPandas(run, f"conv_id {kind}, layout string, fingerprint string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The rows that query op1 adds.
PROBE = (-7, r"\### Assistant: </turn> ok")
