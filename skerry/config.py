"""Settings, passed explicitly; values come from the environment, else from a file of settings, else they have defaults."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "SKERRY_"
_LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$")


def read_env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines; empty without a file.

    Blank lines and those that begin with ``#`` don't count; a value may stand in single or double quotes,
    else it ends at `` #``; of a name's lines the last counts.
    """
    out: dict[str, str] = {}
    if not Path(path).is_file():
        return out
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if line.lstrip().startswith("#") or not (found := _LINE.match(line)):
            continue
        name, value = found.groups()
        if value[:1] in ("'", '"') and value.find(value[0], 1) > 0:
            value = value[1 : value.find(value[0], 1)]
        else:
            value = re.split(r"\s#", value)[0].rstrip()
        out[name] = value
    return out


@dataclass(frozen=True)
class Settings:
    # models
    model_endpoint: str = ""
    model_key: str = ""
    model_version: str = ""
    embedding_model: str = "hash-64"
    chat_model: str = "template"
    question_model: str = "template"
    rewrite_model: str = "template"
    answer_model: str = "template"
    judge_a_model: str = "rule-a"
    judge_b_model: str = "rule-b"
    judge_b_endpoint: str = ""
    judge_b_key: str = ""
    tiebreak_model: str = "rule-c"
    # the literature service
    literature_email: str = ""
    literature_key: str = ""
    literature_domain: str = "cardiology"
    corpus_size: int = 1000
    # collections and tables
    collection: str = "chunks"
    # chunks and questions
    chunk_size: int = 1000
    chunk_overlap: int = 200
    questions_per_chunk: int = 4
    # the experiment
    top_k: int = 10
    pool_depth: int = 10
    min_abstract_chars: int = 200
    alpha: float = 0.05
    # the application
    log_level: str = "INFO"
    data_dir: str = "./data"
    prompts_dir: str = "./prompts"
    results_dir: str = "./results"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = PREFIX, file: str | Path | None = None) -> Settings:
        """Values named ``prefix`` and the field in capitals; the environment goes before ``file``, unknown names don't count."""
        kinds = {"int": int, "float": float, "str": str}
        found = {**(read_env_file(file) if file is not None else {}), **env}
        return cls(**{f.name: kinds[f.type](found[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in found})

    def require(self, *names: str) -> Settings:
        """These settings, if all that are named have a value; else an error that names the missing ones."""
        if missing := [PREFIX + n.upper() for n in names if getattr(self, n) == ""]:
            raise ValueError(f"settings without a value: {', '.join(missing)}")
        return self
