"""Filters of a search: inline syntax, types, dates, names, and how clauses combine."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of kinds of files and the suffixes that they stand for.
FILE_TYPE_ALIASES = {
    "excel": ("xlsx", "xls", "xlsm", "csv"),
    "word": ("docx", "doc"),
    "doc": ("docx", "doc"),
    "web": ("html", "htm"),
    "ppt": ("pptx", "ppt"),
    "text": ("txt", "md", "markdown"),
    "markdown": ("md", "markdown"),
}

#: The words that begin an inline filter.
_TYPE = r"(?i)\b(?:filetype|type|ext)\s*:\s*([A-Za-z0-9,]+)"
_AFTER = r"(?i)\b(?:after|since)\s*:\s*(\d{4}-\d{2}-\d{2})"
_BEFORE = r"(?i)\b(?:before|until)\s*:\s*(\d{4}-\d{2}-\d{2})"


def _all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def parsed_query(query: Column | str) -> dict[str, Column]:
    """term (the query without inline filters, single-spaced), file_types (aliases replaced; distinct, sorted), date_from and date_to (the last one given)."""
    q = F.col(query) if isinstance(query, str) else query
    named = F.filter(F.flatten(F.transform(_all(q, _TYPE), lambda t: F.split(F.lower(t), ","))), lambda t: t != "")
    aliases = F.create_map(*[x for k, v in FILE_TYPE_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    types = F.array_sort(F.array_distinct(F.flatten(F.transform(named, lambda t: F.coalesce(F.try_element_at(aliases, t), F.array(t))))))
    stripped = F.regexp_replace(F.regexp_replace(F.regexp_replace(q, _TYPE, " "), _AFTER, " "), _BEFORE, " ")
    return {
        "term": F.trim(F.regexp_replace(stripped, r"\s+", " ")),
        "file_types": types,
        "date_from": F.try_element_at(_all(q, _AFTER), F.lit(-1)).cast("date"),
        "date_to": F.try_element_at(_all(q, _BEFORE), F.lit(-1)).cast("date"),
    }


def of_types(column: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    include, exclude = sorted(set(include)), sorted(set(exclude))
    kept = column.isin(*include) if include else F.lit(True)
    return kept & ~F.coalesce(column.isin(*exclude), F.lit(False)) if exclude else kept


def in_dates(column: Column, date_from: Column | str | None = None, date_to: Column | str | None = None) -> Column:
    """From the first day to the end of the last. A row without a date is in no range."""
    clauses = []
    if date_from is not None:
        clauses.append(column >= (F.lit(date_from) if isinstance(date_from, str) else date_from).cast("date"))
    if date_to is not None:
        clauses.append(column < F.date_add((F.lit(date_to) if isinstance(date_to, str) else date_to).cast("date"), 1))
    return F.coalesce(reduce(and_, clauses), F.lit(False)) if clauses else F.lit(True)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like_keyword(keyword: str, *columns: Column) -> Column:
    """% and _ of the keyword have their meaning; ASCII letters match in either case, others only as they are."""
    pattern = f"%{keyword.translate(str.maketrans(_UPPER, _LOWER))}%"
    return reduce(lambda a, b: a | b, [F.translate(c, _UPPER, _LOWER).like(pattern) for c in columns])


#: What a query may see and asks for, in columns of its own: principals (null: all rows), file types (none: all), first and last day (null: no bound).
OWN = ("_principals", "_file_types", "_date_from", "_date_to")


def set_number(*columns: str) -> Column:
    """A number for each different set of these columns. Hashed as JSON, as a hash alone takes an empty list for null and runs lists together."""
    return F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def admits(acl: Column, kind: Column, date: Column) -> Column:
    """Whether a row with these columns is one that the query beside it, with the columns OWN, may see and asks for."""
    principals, types, first, last = map(F.col, OWN)
    day = lambda bound, clause: bound.isNull() | F.coalesce(clause, F.lit(False))
    return (
        (principals.isNull() | F.coalesce(F.arrays_overlap(acl, principals), F.lit(False))) & (types.isNull() | (F.size(types) == 0) | F.coalesce(F.array_contains(types, kind), F.lit(False)))
        & day(first, date >= first) & day(last, date < F.date_add(last, 1))
    )


class Masks:
    """The same for many queries at once, in a task: each different set of OWN is one row of a table of bits over the rows of a batch, which are computed once for all queries that have it."""

    def __init__(self, rows: Iterable):
        """rows: of queries, with the columns OWN."""
        self.numbers: dict[tuple, int] = {}
        self.of = np.array([self.numbers.setdefault(self._key(r), len(self.numbers)) for r in rows], np.int64)

    @staticmethod
    def _key(r) -> tuple:  # noqa: ANN001
        principals, types, first, last = (r[c] for c in OWN)
        return None if principals is None else tuple(sorted(set(principals))), tuple(sorted(set(() if types is None else types))), first, last

    def bits(self, batch: pd.DataFrame) -> np.ndarray:
        """A row for each set. batch: acl_principals, document_type, seconds (of the date; null without)."""
        n = len(batch)
        seen: dict[str, np.ndarray] = {}
        for i, acl in enumerate(batch["acl_principals"]):
            for x in acl if acl is not None else ():
                seen.setdefault(x, np.zeros(n, bool))[i] = True
        codes, kinds = pd.factorize(batch["document_type"])
        seconds = batch["seconds"].to_numpy(float)
        out = np.ones((len(self.numbers), n), bool)
        for (principals, types, first, last), row in zip(self.numbers, out, strict=True):
            if principals is not None:
                row &= reduce(or_, (seen[x] for x in principals if x in seen), np.zeros(n, bool))
            if types:
                row &= np.append(np.isin(np.asarray(kinds, object), types), False)[codes]
            if first is not None:
                row &= seconds >= _midnight(first)
            if last is not None:
                row &= seconds < _midnight(last) + 86400
        return out


def _midnight(day: date) -> float:
    return (day - date(1970, 1, 1)).days * 86400.0


def within(column: Column, as_of: Column, hours: float) -> Column:
    """The last hours before as_of, and later."""
    return column >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")


@dataclass
class Clauses:
    """What a search is made of: must and filter restrict, must_not excludes, should adds to the score and, without must and filter, at least one has to match."""

    must: list[Column] = field(default_factory=list)
    filter: list[Column] = field(default_factory=list)
    must_not: list[Column] = field(default_factory=list)
    should: list[Column] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.must) + len(self.filter) + len(self.must_not) + len(self.should)

    def restrict(self, rows: DataFrame) -> DataFrame:
        """Only what restricts; to be used before any vector search, so that its top-k is of visible rows."""
        kept = reduce(and_, [*self.must, *self.filter], F.lit(True))
        return rows.where(reduce(and_, [~F.coalesce(c, F.lit(False)) for c in self.must_not], kept))

    def apply(self, rows: DataFrame) -> DataFrame:
        """Adds score: the sum of the should clauses, null ones 0; rows with none are kept if anything else restricts, or if there are no should clauses."""
        out = self.restrict(rows).withColumn("score", sum((F.coalesce(c, F.lit(0.0)) for c in self.should), F.lit(0.0)))
        if self.should and not (self.must or self.filter):
            out = out.where(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(0.0)) > 0 for c in self.should]))
        return out


@dataclass
class Context:
    """What processors share: settings, and an error that ends the chain."""

    options: dict = field(default_factory=dict)
    error: str | None = None


Processor = Callable[[str, Clauses, Context], str]


def run_chain(processors: Iterable[Processor], term: str, context: Context) -> Clauses | None:
    """Each processor gets what the one before left of the term. None once one of them has set an error."""
    clauses = Clauses()
    for p in processors:
        term = p(term, clauses, context)
        if context.error:
            return None
    return clauses
