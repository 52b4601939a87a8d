"""Rule definitions: YAML text to a validated, immutable record.

A rule names selections and combines them by a condition. YAML documents are read with PyYAML where it is
installed; JSON, a subset of YAML, works without it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # JSON rules still load
    yaml = None

MAX_RULE_BYTES = 1 << 20
#: Limits on what a result may carry.
LIMITS = {"id": 256, "title": 256, "description": 1 << 20, "tags": 100, "tag": 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_TEXTS = ("author", "description", "level", "status", "date", "modified")
_LISTS = ("falsepositives", "fields", "references", "tags")


class RuleError(ValueError):
    """A rule can't be read, validated or compiled."""


@dataclass(frozen=True)
class Logsource:
    product: str | None = None
    category: str | None = None
    service: str | None = None
    definition: str | None = None

    def matches(self, product: str | None = None, category: str | None = None, service: str | None = None) -> bool:
        """Every given value must equal the rule's; a value that isn't given matches all."""
        return all(want is None or want == have for want, have in ((product, self.product), (category, self.category), (service, self.service)))


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    detection: dict[str, Any]
    condition: str
    logsource: Logsource = Logsource()
    author: str | None = None
    description: str | None = None
    level: str | None = None
    status: str | None = None
    date: str | None = None
    modified: str | None = None
    falsepositives: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    path: str | None = None
    multipart: bool = False
    collapse_whitespace: bool = True
    extra: dict[str, Any] = field(default_factory=dict)

    def has_all_tags(self, tags: Iterable[str]) -> bool:
        return set(tags) <= set(self.tags)

    def has_any_tag(self, tags: Iterable[str]) -> bool:
        return bool(set(tags) & set(self.tags))

    def with_tag(self, tag: str) -> Rule:
        from dataclasses import replace

        return self if tag in self.tags else replace(self, tags=(*self.tags, tag))


def is_multipart(text: str) -> bool:
    """Several documents: a ``---`` anywhere but at the start."""
    return not text.startswith("---") and "---" in text


def _documents(text: str) -> Iterator[Any]:
    if yaml is None:
        yield json.loads(text)
        return
    try:
        yield from yaml.safe_load_all(text)
    except yaml.YAMLError as e:
        raise RuleError(f"not valid YAML: {e}") from e


def rules_from_text(text: str | bytes, path: str | None = None, collapse_whitespace: bool = True) -> list[Rule]:
    """All rules of a YAML text, one per document."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    found = [rule_from_dict(d, path, is_multipart(text), collapse_whitespace) for d in _documents(text) if d is not None]
    if not found:
        raise RuleError("no rule in the text")
    return found


def rule_from_text(text: str | bytes, path: str | None = None, collapse_whitespace: bool = True) -> Rule:
    """The first rule of a YAML text."""
    return rules_from_text(text, path, collapse_whitespace)[0]


def rule_from_dict(raw: Any, path: str | None = None, multipart: bool = False, collapse_whitespace: bool = True) -> Rule:
    if not isinstance(raw, dict):
        raise RuleError("a rule is a map")
    title, id_ = raw.get("title"), raw.get("id")
    if not isinstance(title, str) or not title.strip():
        raise RuleError("a rule needs a title")
    if not isinstance(id_, str) or not _UUID.fullmatch(id_):
        raise RuleError("a rule needs an id of the form 8-4-4-4-12 hexadecimal digits")
    detection = raw.get("detection")
    if not isinstance(detection, dict):
        raise RuleError("a rule needs a detection map")
    condition = detection.get("condition")
    if not isinstance(condition, str) or not condition.strip():
        raise RuleError("a detection needs a condition text")
    selections = {k: v for k, v in detection.items() if k != "condition"}
    if any(not isinstance(k, str) or not k.strip() for k in selections):
        raise RuleError("a selection needs a name")
    if not selections and condition.strip().lower() not in ("true", "false", "1", "0"):
        raise RuleError("a detection needs a selection")
    source = raw.get("logsource") or {}
    if not isinstance(source, dict):
        raise RuleError("logsource is a map")
    texts = {k: None if raw.get(k) is None else str(raw[k]) for k in _TEXTS}
    lists = {}
    for k in _LISTS:
        value = raw.get(k)
        if value is not None and not isinstance(value, list):
            raise RuleError(f"{k} is a list")
        lists[k] = tuple(dict.fromkeys(map(str, value or ()))) if k == "tags" else tuple(map(str, value or ()))
    for k, text in (("id", id_), ("title", title), ("description", texts["description"] or "")):
        if len(text) > LIMITS[k]:
            raise RuleError(f"{k} is longer than {LIMITS[k]}")
    if len(lists["tags"]) > LIMITS["tags"] or any(len(t) > LIMITS["tag"] for t in lists["tags"]):
        raise RuleError("too many or too long tags")
    known = {*_TEXTS, *_LISTS, "title", "id", "detection", "logsource"}
    return Rule(
        id=id_,
        title=title,
        detection=selections,
        condition=condition,
        logsource=Logsource(**{k: source.get(k) for k in ("product", "category", "service", "definition")}),
        path=path,
        multipart=multipart,
        collapse_whitespace=collapse_whitespace,
        extra={k: v for k, v in raw.items() if k not in known},
        **texts,
        **lists,
    )


RULE_SCHEMA = (
    "id string, title string, condition string, detection string, author string, description string, level string, status string, date string, modified string, "
    "falsepositives array<string>, fields array<string>, references array<string>, tags array<string>, "
    "logsource struct<product: string, category: string, service: string, definition: string>, path string, enabled boolean"
)


def rules_frame(spark: SparkSession, rules: Iterable[Rule], disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Rule metadata as a DataFrame; the selections are JSON text."""
    rows = [
        (r.id, r.title, r.condition, json.dumps(r.detection, default=str), r.author, r.description, r.level, r.status, r.date, r.modified, list(r.falsepositives), list(r.fields), list(r.references), list(r.tags),
         (r.logsource.product, r.logsource.category, r.logsource.service, r.logsource.definition), r.path, r.id not in disabled)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
