"""Reading JSON out of model answers: fenced, embedded in prose, or cut off."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def without_thoughts(text: str) -> str:
    return re.sub(r"\AThinking Process:\s*", "", re.sub(r"(?s)<think>.*?</think>", "", text).strip())


def _objects(text: str) -> Iterator[str]:
    """Candidates in order: fenced blocks, the whole text, then each balanced span and at last the cut-off rest."""
    yield from (m[1] for m in re.finditer(r"(?s)```(?:json)?\s*(.*?)```", text))
    yield text
    for opener in "{[":
        at = text.find(opener)
        if at >= 0:
            end, _ = _scan(text, at)
            if end:
                yield text[at:end]
            elif opener == "{" and not 0 <= text.find("[") < at:
                return  # cut off: a list inside it is not the answer


def _scan(text: str, at: int) -> tuple[int, list[str]]:
    """The end of the value that opens at a position (0 if it never closes) and the closers still missing."""
    stack: list[str] = []
    quoted = escaped = False
    for i in range(at, len(text)):
        ch = text[i]
        if quoted:
            quoted, escaped = (quoted if escaped or ch != '"' else False), ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not stack or stack.pop() != ch:
                return 0, stack
            if not stack:
                return i + 1, []
    return 0, stack + (['"'] if quoted else [])


def repaired(text: str) -> str | None:
    """A cut-off value with its unfinished tail dropped and its brackets closed, innermost first."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    own = text[at:]
    # shorter and shorter: a cut at each comma or opening bracket, from the right
    cuts = [len(own)] + [m.start() if m[0] == "," else m.end() for m in reversed(list(re.finditer(r"[,{\[]", own)))]
    for cut in cuts:
        head = own[:cut].rstrip()
        end, missing = _scan(head, 0)
        if not end and '"' not in missing:
            try:
                json.loads(fixed := head + "".join(reversed(missing)))
                return fixed
            except ValueError:
                continue
    return None


def read(text: str | None) -> dict:
    """The object in a text; a list becomes {"items": list}; anything else {}."""
    text = without_thoughts(text or "")
    for part in _objects(text):
        try:
            value = json.loads(part.strip())
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            return value if isinstance(value, dict) else {"items": value}
    fixed = repaired(text)
    value = json.loads(fixed) if fixed else {}
    return value if isinstance(value, dict) else {"items": value}


def node_ids(text: str | None) -> list[dict]:
    """The dicts with a node_id in a list answer."""
    items = read(text).get("items", [])
    return [x for x in items if isinstance(x, dict) and x.get("node_id")]


def parsed(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    """df with the object in a column as JSON text, for from_json."""
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [json.dumps(read(x.as_py()), ensure_ascii=False) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names)

    return df.mapInArrow(run, df.withColumn(out, F.lit("")).schema)
