"""Arrow-batched helpers for open JSON documents, where no built-in can walk an unknown tree."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"([^.\[\]]+)|\[(0|[1-9][0-9]*)\](?=$|\.|\[)|(\.)")


def path_tokens(path: str) -> list[str | int] | None:
    """Dot/bracket path to keys and indexes; None for a malformed path."""
    if not path.strip() or path.endswith("."):
        return None
    tokens: list[str | int] = []
    position, dotted = 0, True
    while position < len(path):
        match = _TOKEN.match(path, position)
        if match is None:
            return None
        key, index, dot = match.groups()
        if dot:
            if dotted:
                return None
            dotted = True
        elif key is not None:
            # a key straight after "]" would need a dot; the pattern's look-ahead already refuses it
            tokens.append(key)
            dotted = False
        else:
            tokens.append(int(index))
            dotted = False
        position = match.end()
    return tokens or None


def has_path(document: object, tokens: list[str | int] | None) -> bool:
    """A JSON null counts as present; only an absent key or index does not."""
    if tokens is None:
        return False
    node = document
    for token in tokens:
        if isinstance(token, int):
            if not isinstance(node, list) or token >= len(node):
                return False
        elif not isinstance(node, dict) or token not in node:
            return False
        node = node[token]
    return True


@F.pandas_udf(T.BooleanType())
def json_path_exists(documents: pd.Series, paths: pd.Series) -> pd.Series:
    """Whether a document holds a path; a null document or path gives false. Rows in a row with one document parse it once."""
    known: dict[str, list[str | int] | None] = {}
    out, held, document = [], None, None
    for text, path in zip(documents, paths):
        if text is None or path is None:
            out.append(False)
            continue
        if path not in known:
            known[path] = path_tokens(path)
        if text != held:
            held, document = text, json.loads(text)
        out.append(has_path(document, known[path]))
    return pd.Series(out, dtype=bool)


def number_literal(value: float) -> str:
    """Shortest decimal form: no exponent between 1e-6 and 1e21, whole numbers without a fraction."""
    if not math.isfinite(value):
        raise ValueError("a document may not hold non-finite numbers")
    if value == 0:
        return "0"
    digits, _, exponent = repr(value).partition("e")
    if not exponent:
        return digits.removesuffix(".0")
    power = int(exponent)
    if 0 < power < 21:
        whole, _, rest = digits.partition(".")
        return whole + rest.ljust(power, "0")
    if -7 < power < 0:
        sign = "-" if digits.startswith("-") else ""
        return f"{sign}0.{'0' * (-power - 1)}{digits.lstrip('-').replace('.', '')}"
    return f"{digits.removesuffix('.0')}e{power:+d}"


def canonical_text(node: object, drop=None) -> str:
    """JSON text with keys sorted at every depth; ``drop(key)`` leaves keys out."""
    if isinstance(node, dict):
        keys = sorted((k for k in node if drop is None or not drop(k)), key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_text(node[k], drop)}" for k in keys) + "}"
    if isinstance(node, list):
        return "[" + ",".join(canonical_text(item, drop) for item in node) + "]"
    if isinstance(node, float):
        return number_literal(node)
    return json.dumps(node, ensure_ascii=False)


class _Unusual(Exception):
    """A number that the encoder would not write as ``number_literal`` does."""


def _plain_number(text: str) -> int | float:
    value = float(text)
    if value.is_integer() and abs(value) < 1e15:
        return int(value)
    if 1e-4 <= abs(value) < 1e15:
        return value
    raise _Unusual(text)


_READER, _WRITER = json.JSONDecoder(parse_float=_plain_number), json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical(text: str) -> str:
    """Canonical text of a document. ASCII texts without escapes, whose keys sort as they are, go through the encoder as a whole."""
    if text.isascii() and "\\u" not in text and "NaN" not in text and "Infinity" not in text:
        try:
            return _WRITER.encode(_READER.decode(text))
        except _Unusual:
            pass
    return canonical_text(json.loads(text))


@F.pandas_udf(T.StringType())
def canonical_json(documents: pd.Series) -> pd.Series:
    return documents.map(canonical, na_action="ignore")


def is_generated_key(key: str) -> bool:
    return key == "provenance" or "fingerprint" in key


@F.pandas_udf(T.StringType())
def without_generated_fields(documents: pd.Series) -> pd.Series:
    """Canonical JSON without provenance and fingerprint keys at any depth."""
    return documents.map(lambda text: canonical_text(json.loads(text), is_generated_key), na_action="ignore")


def strings_with_score(node: object) -> list[str]:
    """All string leaves that mention "score", in document order."""
    if isinstance(node, str):
        return [node] if "score" in node else []
    children = node if isinstance(node, list) else node.values() if isinstance(node, dict) else ()
    return [found for child in children for found in strings_with_score(child)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def score_strings(documents: pd.Series) -> pd.Series:
    def found(text: str | None) -> list[str]:
        try:
            return strings_with_score(json.loads(text)) if text is not None else []
        except ValueError:
            return []
    return documents.map(found)
