"""Python syntax check: the one step no built-in expression can do."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

RESULT = StructType().add("ok", BooleanType()).add("line", IntegerType()).add("message", StringType())


def parse_result(code: str | None) -> tuple[bool | None, int | None, str | None]:
    if code is None:
        return None, None, None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except SyntaxError as e:
        return False, e.lineno, e.msg
    except Exception as e:  # null bytes, nesting too deep
        return False, None, str(e)
    return True, None, None


@F.pandas_udf(RESULT)
def python_syntax(codes: pd.Series) -> pd.DataFrame:
    """Batched over Arrow; a text repeated within a batch is parsed once. NULL stays NULL."""
    known = {code: parse_result(code) for code in codes.unique()}
    out = pd.DataFrame([known[c] for c in codes], columns=["ok", "line", "message"])
    return out.astype({"ok": "boolean", "line": "Int32"})
