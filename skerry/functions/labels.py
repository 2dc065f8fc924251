"""Parsing of judges' answers; JSON with Python's rules, so an Arrow function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

# The answer's field, and what says "relevant" where an answer isn't JSON.
FIELD = "relevant"
SAID = re.compile(r"relevant\D{0,4}1")


def _field(answer: str) -> bool | None:
    """What the object between the outermost braces says, or None if there is none that can be read."""
    first, last = answer.find("{"), answer.rfind("}")
    if not 0 <= first < last:
        return None
    try:
        value = json.loads(answer[first : last + 1]).get(FIELD, 0)
        return value not in (float("inf"), float("-inf")) and int(value) != 0  # an infinite verdict is none
    except (ValueError, TypeError):
        return None


def relevant(answer: str | None) -> bool:
    """Whether an answer says that a text is relevant; null and what can't be read say no.

    A readable object decides alone: one without the field says no.  Else the answer, in lower case,
    must begin with a 1 or have one shortly after the word.
    """
    verdict = _field(answer or "")
    if verdict is None:
        plain = (answer or "").lower()
        verdict = plain.lstrip()[:1] == "1" or SAID.search(plain) is not None
    return verdict


@pandas_udf(BooleanType())
def relevant_label(answers: pd.Series) -> pd.Series:
    return answers.map(relevant)
