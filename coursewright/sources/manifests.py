"""YAML manifests: to JSON in the executors, then typed; booleans and numbers as YAML 1.2 reads them."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.schemas import MANIFEST

#: The core schema of YAML 1.2.
CORE = [
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
]


@functools.cache
def loader(fast: bool = False):
    """A safe loader whose plain scalars follow CORE; `no`, dates and times stay text. The fast one is libyaml's, where it is there."""
    import yaml

    class Core(yaml.CSafeLoader if fast and yaml.__with_libyaml__ else yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    for tag, pattern, first in CORE:
        Core.add_implicit_resolver(tag, re.compile(pattern), first)
    Core.add_constructor("tag:yaml.org,2002:int", lambda self, node: int(node.value, 0) if node.value[:2] in ("0x", "0o") else int(node.value))
    Core.add_constructor("tag:yaml.org,2002:bool", lambda self, node: node.value.lower() == "true")
    return Core


#: Values that a document may have when its aliases are written out.
MOST_VALUES = 1_000_000


def written_out(value, known: dict[int, int]) -> int:
    """How many values a value holds when aliases, which are one object each, are written out."""
    if not isinstance(value, (dict, list)):
        return 1
    if id(value) not in known:
        known[id(value)] = MOST_VALUES + 1  # what holds itself has no end
        known[id(value)] = 1 + sum(written_out(v, known) for v in (value.values() if isinstance(value, dict) else value))
    return known[id(value)]


#: What libyaml reads as the plain loader does: printable ASCII without flow collections, quotes that go on, tabs or entries nested in one line.
PLAIN = re.compile(r"[ -~\n]*")
ODD = re.compile(r"[\[\]{}!|&*%`@?\\]|>[-+0-9]*#|[-:][ ]*[-:][ ]*[-:]|^(?:---|\.\.\.)", re.MULTILINE)
MOST_DEEP = 50


def loaded(text: str):
    """The value of a YAML text: plain ones by libyaml, all others, and those that it refuses, by the plain loader, whose errors count."""
    import yaml

    if PLAIN.fullmatch(text) and not ODD.search(text) and "\n" + " " * MOST_DEEP not in text:
        try:
            return yaml.load(text, loader(True))  # noqa: S506  the loaders are safe ones
        except (yaml.YAMLError, TypeError, ValueError):
            pass
    return yaml.load(text, loader())  # noqa: S506


def to_json(text: str | None) -> tuple[str | None, str | None]:
    """JSON, or why there is none: bad YAML, values that JSON lacks, too deep nesting, aliases that grow without bound."""
    import yaml

    try:
        value = loaded(text or "")
        if written_out(value, {}) > MOST_VALUES:
            return None, f"more than {MOST_VALUES} values when aliases are written out"
        return (None if value is None else json.dumps(value, ensure_ascii=False, allow_nan=False)), None
    except RecursionError:
        return None, "nested too deeply"
    except (yaml.YAMLError, TypeError, ValueError) as error:
        return None, str(error)


def manifests(files: DataFrame) -> DataFrame:
    """path, raw (JSON; null for an empty document), error, manifest (typed) of YAML or JSON files (path, raw)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *to_json(r)) for p, r in zip(batch["path"], batch["raw"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "raw", "error"])

    return files.select("path", "raw").mapInPandas(work, "path string, raw string, error string").withColumn("manifest", F.from_json("raw", MANIFEST))
