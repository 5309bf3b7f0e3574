"""Job specifications: what to select on which pages, and what to do with the items found."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.functions.text import bound, strip

# Defaults of a job specification.
DEFAULT_INTERVAL = 600
DEFAULT_ATTRIBUTE = "text"

SCHEMA = (
    "name string, url string, selector string, fields array<struct<name:string,selector:string,attr:string>>, "
    "keywords array<string>, search_fields array<string>, hash_fields array<string>, urls array<string>, "
    "interval bigint, workers bigint, enabled boolean, debug boolean, headers map<string,string>, "
    "notification struct<enabled:boolean,timeout:bigint,title:string,body:string>, "
    "webhook struct<enabled:boolean,url:string,headers:map<string,string>>, "
    "proxy struct<enabled:boolean,rotate:string,urls:array<string>>"
)


@dataclass(frozen=True)
class FieldSpec:
    name: str
    selector: str
    attr: str = DEFAULT_ATTRIBUTE

    @classmethod
    def parse(cls, text: str) -> FieldSpec:
        """``name:selector`` or ``name:selector@attribute``."""
        name, colon, rest = text.partition(":")
        if not colon:
            raise ValueError(f"field {text!r} is not written as name:selector or name:selector@attr")
        selector, _, attr = rest.partition("@")
        return cls(name.strip(), selector.strip(), attr.strip() or DEFAULT_ATTRIBUTE)


def shorthand(text: Column) -> Column:
    """The same reading for a column of field texts; NULL when there is no colon."""

    def read(value: Column) -> Column:
        cut = F.locate(":", value)
        name = F.substring(value, F.lit(1), cut - 1)
        rest = F.substring(value, cut + 1, F.length(value))
        return F.when(cut > 0, bound(rest, lambda r: parts(name, r)))

    def parts(name: Column, rest: Column) -> Column:
        attr = strip(F.regexp_extract(rest, "(?s)@(.*)$", 1))
        return F.struct(
            strip(name).alias("name"),
            strip(F.regexp_extract(rest, "(?s)^([^@]*)", 1)).alias("selector"),
            F.when(attr == "", F.lit(DEFAULT_ATTRIBUTE)).otherwise(attr).alias("attr"),
        )

    return bound(text, read)


@dataclass(frozen=True)
class Notification:
    enabled: bool = True
    timeout: int = 0
    title: str | None = None
    body: str | None = None


@dataclass(frozen=True)
class JobSpec:
    name: str
    url: str
    selector: str
    fields: Sequence[FieldSpec | str]
    keywords: Sequence[str] | None = None
    search_fields: Sequence[str] | None = None
    hash_fields: Sequence[str] | None = None
    urls: Sequence[str] | None = None
    interval: int = DEFAULT_INTERVAL
    workers: int | None = None
    enabled: bool = True
    debug: bool = False
    headers: dict[str, str] | None = None
    notification: Notification | None = None
    webhook: dict | None = None
    proxy: dict | None = None

    def __post_init__(self) -> None:
        parsed = tuple(f if isinstance(f, FieldSpec) else FieldSpec.parse(f) for f in self.fields)
        object.__setattr__(self, "fields", parsed)

    @property
    def field_names(self) -> list[str]:
        return list(dict.fromkeys(f.name for f in self.fields))

    @property
    def job_id(self) -> str:
        letters = "".join(c.lower() if kept_in_ids(c) else "_" for c in self.name)
        return letters.strip("_")

    @property
    def targets(self) -> list[str]:
        return list(self.urls) if self.urls else [self.url]


def kept_in_ids(sign: str) -> bool:
    """The same letters and digits that the column form of the job id keeps, marks that count as alphabetic included."""
    return regex.match(r"[\p{Alphabetic}\p{N}]", sign) is not None


def load_specs(path: str | Path) -> list[JobSpec]:
    """Specifications from a TOML file: one job at the top level, or several under ``jobs``."""
    content = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    return [spec_from(entry) for entry in content.get("jobs", [content])]


def spec_from(entry: dict) -> JobSpec:
    known = {k: v for k, v in entry.items() if k in JobSpec.__dataclass_fields__}
    known["fields"] = [
        f if isinstance(f, str) else FieldSpec(f["name"], f["selector"], f.get("att", DEFAULT_ATTRIBUTE)) for f in entry["fields"]
    ]
    if "notification" in entry:
        known["notification"] = Notification(**entry["notification"])
    return JobSpec(**known)


def spec_table(spark: SparkSession, specs: Iterable[JobSpec]) -> DataFrame:
    rows = [
        (
            s.name, s.url, s.selector, [(f.name, f.selector, f.attr) for f in s.fields],
            _list(s.keywords), _list(s.search_fields), _list(s.hash_fields), _list(s.urls),
            s.interval, s.workers, s.enabled, s.debug, s.headers,
            None if s.notification is None else (
                s.notification.enabled, s.notification.timeout, s.notification.title, s.notification.body
            ),
            None if s.webhook is None else (s.webhook.get("enabled", True), s.webhook["url"], s.webhook.get("headers")),
            None if s.proxy is None else (s.proxy.get("enabled", True), s.proxy.get("rotate", "Sticky"), s.proxy["urls"]),
        )
        for s in specs
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _list(values: Sequence[str] | None) -> list[str] | None:
    return None if values is None else list(values)
