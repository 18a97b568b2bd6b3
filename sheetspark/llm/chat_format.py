"""Chat formatting: records of many layouts become canonical turns, and turns become marked text.

A record's layout is known by its fingerprint, a hash of its nested field paths
(``messages[].role``; fields that no mapping names don't count). Fingerprints pick
a declarative mapping; a mapping with optional fields has a fingerprint for each
choice of them. A record that no mapping fits gets an error that tells its paths,
and no turns.

The text of a turn stands between its mark and ``</s>``. Control strings inside
texts and roles get a backslash after their first character (one more, if they had
some), which is undone on reading; in roles, which end with their line, backslashes
and line breaks are escaped as well. The loss mask covers the assistant's texts.

Layouts whose roles have other names (``human``, ``gpt``) say in their mapping what
these mean; in all others a role stays as it is.

A conversation is a stream of turns in order, cut into parts of about
``PART_CHARS`` so that no row grows with it; offsets run on over the parts.

Results at the edges: a record that isn't JSON, isn't an object, has a list entry
that isn't one, or has none of a mapping's fields, is a row with an error and without
turns; null text or role is empty; a very long text makes a part of its own; other
columns pass unchanged but for those with a result's name; turns of equal number are ordered
by role and text, repeated ones stay; a null conversation id is a conversation; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetspark.llm.common import with_arrow

BEGIN, END = "<s>", "</s>"
MARKS = {"assistant": "[/INST]"}
OTHER_MARK = "[INST]"
CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[]\\*)\\(?=/?s>|/?INST\])")
PART_CHARS = 1_000_000

ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


@dataclass(frozen=True)
class Turn:
    """One turn of a fixed role, from fields joined by an empty line."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each entry of a list, or for the record itself if ``items`` is empty."""

    items: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles


@dataclass(frozen=True)
class Mapping:
    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Turn | Each, ...]
    least: int = 0  # of the optional paths, how many must be there


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), ("system",), (Turn("system", ("system",)), Each("messages", "role", "content"))),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",), (Turn("system", ("system",)), Each("conversations", "from", "value", ROLES))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Mapping("prompt", ("prompt",), ("completion", "response", "system"), (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("completion", "response")))),
    Mapping("question", ("question", "answer"), ("context", "system"), (Turn("system", ("system",)), Turn("user", ("context", "question")), Turn("assistant", ("answer",)))),
    Mapping("turn", (), ("role", "text"), (Each("", "role", "text"),), 1),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """The paths of all leaves that are not null; a list's entries share a path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value))
    return set() if value is None else {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@cache
def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[dict[str, Mapping], frozenset[str]]:
    """Mappings by fingerprint (the first that claims one has it), and all paths that they name."""
    by: dict[str, Mapping] = {}
    for m in mappings:
        for some in chain.from_iterable(combinations(m.optional, k) for k in range(m.least, len(m.optional) + 1)):
            by.setdefault(fingerprint({*m.needed, *some}), m)
    return by, frozenset(p for m in mappings for p in (*m.needed, *m.optional))


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record) -> tuple[list[tuple[str, str]], str | None, str | None]:
    """Turns, layout and error of one record."""
    if not isinstance(record, dict):
        return [], None, "not a record"
    by, known = registry()
    paths = field_paths(record) & known
    mapping = by.get(fingerprint(paths))
    if mapping is None:
        return [], None, "no mapping for: " + ", ".join(sorted(paths))
    turns: list[tuple[str, str]] = []
    for rule in mapping.turns:
        if isinstance(rule, Each):
            for entry in record.get(rule.items) or [] if rule.items else [record]:
                if not isinstance(entry, dict):
                    return [], None, f"an entry of {rule.items} is no object"
                role = as_text(entry.get(rule.role))
                turns.append((dict(rule.roles).get(role, role), as_text(entry.get(rule.text))))
        elif given := [as_text(record[p]) for p in rule.paths if record.get(p) is not None]:
            turns.append((rule.role, "\n\n".join(given)))
    return turns, mapping.name, None


TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
TURN_ARROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
CANONICAL = [T.StructField("turns", T.ArrayType(TURN)), T.StructField("layout", T.StringType()), T.StructField("error", T.StringType())]


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds turns, layout and error, from a column of JSON texts."""

    def read(text: str | None):
        try:
            found = canonical(json.loads(text or "null"))
            for turn in found[0]:
                "".join(turn).encode()
            return found
        except UnicodeEncodeError:
            return [], None, "half of a surrogate pair, which no text can hold"
        except (ValueError, RecursionError):
            return [], None, "not JSON"

    def make():
        def call(column: pa.Array) -> list[pa.Array]:
            found = [read(t) for t in column.to_pylist()]
            turns = pa.array([[{"role": r, "text": t} for r, t in f[0]] for f in found], TURN_ARROW)
            return [turns, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())]

        return call

    return with_arrow(records, [record], CANONICAL, make, [c for c in records.columns if c != record])


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def role_line(role: str) -> str:
    """A role in one line, without control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def head(role: str) -> str:
    return BEGIN + MARKS.get(role, OTHER_MARK) + role_line(role) + "\n"


def parse(formatted: str) -> Iterator[tuple[str, str, int]]:
    """role, escaped text and the place of the text for each turn."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        mark = formatted[at + len(BEGIN) :]
        size = len(MARKS["assistant"]) if mark.startswith(MARKS["assistant"]) else len(OTHER_MARK)
        yield role_of(formatted[at + len(BEGIN) + size : line]), formatted[line + 1 : stop], line + 1
        at = stop + len(END)


FORMATTED = "conv_id long, part long, first_char long, formatted string, loss_spans array<struct<start:long,end:long>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of a conversation in one task, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Formats rows (conv_id, turn, turns) into parts; loss_spans count from the conversation's first character."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "turns")
    rows = in_order(rows, "turn", "turns").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        conv, begun, part, place = None, False, 0, 0
        texts: list[str] = []
        spans: list[dict] = []

        def close() -> None:
            nonlocal texts, spans, part, held
            if texts:
                joined = "".join(texts)
                out.append((conv, part, place - len(joined), joined, spans))
                held += len(joined)
                texts, spans, part = [], [], part + 1

        size = 0
        for batch in batches:
            for own, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or own != conv:
                    close()
                    conv, begun, part, place, size = own, True, 0, 0, 0
                for t in entries or []:
                    top, body = head(t["role"] or ""), escape(t["text"] or "")
                    if t["role"] == "assistant":
                        spans.append({"start": place + len(top), "end": place + len(top) + len(body)})
                    texts += [top, body, END]
                    place += len(top) + len(body) + len(END)
                    size += len(top) + len(body) + len(END)
                    if size >= part_chars:
                        close()
                        size = 0
            if held >= part_chars:
                yield rows_batch(out)
                out, held = [], 0
        close()
        if out:
            yield rows_batch(out)

    return rows.mapInArrow(run, FORMATTED)


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS_ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "first_char", "formatted", "loss_spans"])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted parts say, by conversation, read from their text and spans alone."""
    rows = in_order(formatted, "part").select("conv_id", "first_char", "formatted", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        out: list[tuple] = []

        def close() -> None:
            if begun:
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for own, first, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or own != conv:
                    close()
                    conv, begun = own, True
                    turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, body, _ in parse(text):
                    turns.update(f"{role}\n{unescape(body)}\n".encode())
                    n += 1
                for s in spans:
                    under = unescape(text[s["start"] - first : s["end"] - first])
                    loss.update(under.encode())
                    chars += len(under)
                total += len(text)
            if len(out) >= 5000:
                yield as_rows(out)
                out = []
        close()
        if out:
            yield as_rows(out)

    return rows.mapInArrow(run, DIGESTS)


def as_rows(out: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
