"""Tool definitions and arguments as JSON: normal types, signatures, inventories, arguments of instructions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weftline.functions import dialogue, structure

# How benchmark definitions spell types.
TYPES = {"dict": "object", "list": "array", "tuple": "array", "float": "number", "integer": "integer", "string": "string", "boolean": "boolean"}


def plain_schema(value):
    """A schema with usual type names at every place and without defaults."""
    if isinstance(value, list):
        return [plain_schema(x) for x in value]
    if not isinstance(value, dict):
        return value
    out = {k: plain_schema(x) for k, x in value.items() if k != "default"}
    kind = out.get("type")
    return out | {"type": TYPES[kind]} if isinstance(kind, str) and kind in TYPES else out


def arguments(call) -> dict:
    """A call's arguments: an object, or the text of one; anything else is no arguments."""
    given = (call or {}).get("arguments", {})
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            return {}
    return given if isinstance(given, dict) else {}


def signature(functions: list[dict]) -> str:
    """The digest of the functions' names and repaired parameters, whatever their order."""
    items = []
    for f in functions:
        parameters = f.get("parameters")
        items.append(structure.canonical({"name": f.get("name"), "parameters": dialogue.repair(parameters if isinstance(parameters, dict) else {}, [])}))
    return hashlib.sha256(structure.canonical(sorted(items)).encode()).hexdigest()


def inventory(docs: list[dict], excluded: list[str]) -> list[dict]:
    """Function definitions as tools, sorted by name; of equal names the last counts. Without parameters: an empty object."""
    kept = {d["name"]: d for d in docs if d["name"] not in excluded}
    empty = {"type": "object", "properties": {}}
    return [
        {"type": "function", "function": {"name": n, "description": kept[n].get("description", ""), "parameters": plain_schema(kept[n].get("parameters", {})) or empty}}
        for n in sorted(kept)
    ]


def instruction_ids(ids: list | None) -> list[str]:
    """Texts without white space at their ends; nulls and empty ones go."""
    return [t for t in (str(x).strip() for x in ids or [] if x is not None) if t]


def instruction_arguments(given, n: int) -> list[dict]:
    """n objects: a list's (what is no object is empty), one object for all, or none; the last is repeated, a rest is cut
    off, and entries that are null go."""
    if isinstance(given, list):
        out = [dict(x) if isinstance(x, dict) else {} for x in given]
    else:
        out = [dict(given) if isinstance(given, dict) else {} for _ in range(n)]
    while len(out) < n:
        out.append(dict(out[-1]) if out else {})
    return [{k: v for k, v in x.items() if v is not None} for x in out[:n]]


def json_udf(rule):
    """A pandas UDF from JSON texts to the canonical JSON of rule(value); null for a null or for what is no JSON."""

    @F.pandas_udf(StringType())
    def apply(x: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else structure.canonical(rule(json.loads(text)))
            except ValueError:
                return None

        return x.map(one)

    return apply


py_plain_schema = json_udf(plain_schema)
py_arguments = json_udf(arguments)
py_signature = json_udf(signature)


@F.pandas_udf(StringType())
def py_inventory(docs: pd.Series, excluded: pd.Series) -> pd.Series:
    return pd.Series([structure.canonical(inventory(json.loads(d), list(e))) for d, e in zip(docs, excluded)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def py_instruction_arguments(given: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([[structure.canonical(x) for x in instruction_arguments(None if g is None else json.loads(g), int(k))] for g, k in zip(given, n)])
