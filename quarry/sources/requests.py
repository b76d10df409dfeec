"""Payment requests as JSON bodies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.features import request_status
from quarry.schemas import MAX_BODY_BYTES, REQUEST, UINT32_MAX

_FLOAT_MAX = 3.4028234663852886e38


def _number(x):
    if isinstance(x, bool) or not isinstance(x, int | float) or abs(x) > _FLOAT_MAX:
        raise ValueError(x)


def _count(x):
    if isinstance(x, bool) or not isinstance(x, int) or not 0 <= x <= UINT32_MAX:
        raise ValueError(x)


def _text(x):
    if not isinstance(x, str):
        raise ValueError(x)


def _flag(x):
    if not isinstance(x, bool):
        raise ValueError(x)


def _texts(x):
    for y in x if isinstance(x, list) else [0]:
        if y is not None:
            _text(y)


_SHAPE = {
    "id": _text,
    "transaction": {"amount": _number, "installments": _count, "requested_at": _text},
    "customer": {"avg_amount": _number, "tx_count_24h": _count, "known_merchants": _texts},
    "merchant": {"id": _text, "mcc": _text, "avg_amount": _number},
    "terminal": {"is_online": _flag, "card_present": _flag, "km_from_home": _number},
    "last_transaction": {"timestamp": _text, "km_from_current": _number},
}


def _plain(value, shape) -> dict:
    """The known fields of an object under their own names (they are found in any case); raises ValueError on a wrong type."""
    if not isinstance(value, dict):
        raise ValueError(value)
    lower, out = {k.lower(): k for k in shape}, {}
    for k, v in value.items():
        name = k if k in shape else lower.get(k.lower())
        if name is None or v is None:
            continue
        if isinstance(shape[name], dict):
            v = _plain(v, shape[name])
        else:
            shape[name](v)
        out[name] = v
    return out


def _no_constant(x):
    raise ValueError(x)


def strict(body: str | None) -> str | None:
    """A body with its fields under their usual names, or null if it is no JSON object of the right types."""
    try:
        return json.dumps(_plain(json.loads(body, parse_constant=_no_constant), _SHAPE))
    except (ValueError, TypeError, RecursionError):
        return None


_TEXT = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_JSON = {
    _text: _TEXT,
    _number: r"-?(?:0|[1-9][0-9]{0,29})(?:\.[0-9]{1,40})?",
    _count: r"(?:0|[1-9][0-9]{0,8})",
    _flag: r"(?:true|false)",
    _texts: rf"\[\s*(?:(?:{_TEXT}|null)(?:\s*,\s*(?:{_TEXT}|null))*+)?\s*\]",
}


def _pattern(shape: dict) -> str:
    fields = [rf'"{k}"\s*:\s*{"(?:null|" + _pattern(x) + ")" if k == "last_transaction" else _pattern(x) if isinstance(x, dict) else _JSON[x]}' for k, x in shape.items()]
    # a last transaction may be left out
    last = rf"(?:\s*,\s*{fields.pop()})?" if "last_transaction" in shape else ""
    return r"\{\s*" + r"\s*,\s*".join(fields) + last + r"\s*\}"


#: Bodies as clients write them: every field, in the usual order, with the right type and nothing around the object. The
#: type of each is known without a parser; all others are parsed by `strict`.
USUAL = rf"^\s*{_pattern(_SHAPE)}\s*$".replace(r"\s", r"[ \t\n\r]").replace("$", r"\z")

#: What the first character of a body tells the parser.
_AS_IT_IS, _PARSE, _LARGE = "+", "?", "!"


def _parsed(text: str | None) -> str | None:
    if not text or text == _LARGE:
        return text
    return text[1:] if text[0] == _AS_IT_IS else strict(text[1:])


@F.pandas_udf(StringType())
def _strict(bodies: pd.Series) -> pd.Series:
    return bodies.map(_parsed)


def decode(df: DataFrame, body: str = "body", usual: bool = True) -> DataFrame:
    """df with the request's columns and status: 413 for a body of more than 65,536 bytes, 400 for a malformed or invalid one, else 200.

    Absent and null fields count as 0, '' and false where they are used. Types are checked strictly (a fraction or a
    negative number is no count, nothing may follow the object), for which Spark's own parser is too lenient: bodies of
    the usual form are told by a pattern, others are parsed in Python. Without `usual` all are; the result is the same.
    Columns of df named as a request's are replaced. The body itself goes no further than the parser, unless it is asked for.
    """

    def marked(text):
        known = text.rlike(USUAL) if usual else F.lit(False)
        return F.when(F.octet_length(text) > MAX_BODY_BYTES, F.lit(_LARGE)).otherwise(F.concat(F.when(known, F.lit(_AS_IT_IS)).otherwise(F.lit(_PARSE)), text))

    # inside a transform, so that a body that is itself an expression is computed once
    plain = df.withColumn("__plain", _strict(F.get(F.transform(F.array(body), marked), F.lit(0))))
    names = [c for c in df.columns if c.lower() not in {"status", *(f.split(" ")[0] for f in _SHAPE)}]
    rows = plain.withColumn("__r", F.from_json("__plain", REQUEST)).select(*names, "__plain", "__r.*")
    status = F.when(F.col("__plain") == _LARGE, 413).when(F.col("__plain").isNull(), 400).otherwise(request_status())
    return rows.withColumn("status", status).drop("__plain")
