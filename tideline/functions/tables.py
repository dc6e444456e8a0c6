"""Names of tables: filters by pattern, topics, kinds of columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemas of the server itself, and the state table, whose capture would feed on itself.
BUILT_IN_EXCLUDES = ("mysql.*", "sys.*", "performance_schema.*", "information_schema.*", "*.flow_state")

#: Column types whose bytes are not text.
BINARY_TYPES = (
    "blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary", "bit", "geometry", "point", "linestring", "polygon",
    "multipoint", "multilinestring", "multipolygon", "geomcollection", "geometrycollection", "vector",
)
NUMBER_TYPES = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "float", "double", "year")


def glob_regex(pattern: str) -> str:
    """The regular expression of a pattern: * any text and ? any character but a slash, [..] a class, backslash takes away a meaning."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k == len(pattern):
                raise ValueError(f"pattern ends in a backslash: {pattern!r}")
            out.append(re.escape(pattern[k]))
        elif c == "[":
            found = re.compile(r"\[(\^?)((?:\\.|[^\]\\])+)\]").match(pattern, k)
            if not found:
                raise ValueError(f"class without an end: {pattern!r}")
            out.append(f"[{found[1]}{found[2].replace('[', chr(92) + '[').replace('&', chr(92) + '&')}]")
            k = found.end() - 1
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def _any(patterns: Sequence[str]) -> str:
    return f"^(?:{'|'.join(map(glob_regex, patterns))})$"


def captured(fqtn: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), built_in: bool = True) -> Column:
    """Whether a table is captured: no exclusion matches, and an inclusion does or there is none."""
    out = (*(BUILT_IN_EXCLUDES if built_in else ()), *exclude)
    wanted = fqtn.rlike(_any(include)) if include else F.lit(True)
    return wanted & ~fqtn.rlike(_any(out)) if out else wanted


def fqtn(db: str = "db", table: str = "table") -> Column:
    return F.concat_ws(".", F.col(f"`{db}`"), F.col(f"`{table}`"))


def topic(db: Column, table: Column, template: str = "cdc.{database}.{table}", overrides: Mapping[str, str] | None = None) -> Column:
    name = F.replace(F.replace(F.lit(template), F.lit("{database}"), db), F.lit("{table}"), table)
    if not overrides:
        return name
    literal = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))
    return F.coalesce(F.try_element_at(literal, F.concat_ws(".", db, table)), name)


def column_kind(data_type: Column) -> Column:
    """text, binary or json, by the type that the server names."""
    return F.when(data_type == "json", "json").when(data_type.isin(*BINARY_TYPES), "binary").otherwise("text")


def wire_kind(data_type: Column) -> Column:
    """As column_kind(), with numbers and booleans, whose text stands in JSON without quotes, apart."""
    return F.when(data_type.isin(*NUMBER_TYPES), "number").when(data_type.isin("bool", "boolean"), "bool").otherwise(column_kind(data_type))


def truncated(text: Column, n: int) -> Column:
    """At most n bytes of a text for a log line; a code point that the cut would split is left out, for a text holds no part of one."""
    data = F.encode(text, "UTF-8")
    splits = lambda k: F.hex(F.substr(data, F.lit(k + 1), F.lit(1))).between("80", "BF")  # noqa: E731  whether a code point goes on after byte k
    end = F.lit(max(n - 3, 0))
    for k in range(max(n - 2, 0), n + 1):
        end = F.when(splits(k), end).otherwise(k)
    return F.when(F.octet_length(text) > n, F.concat(F.decode(F.substr(data, F.lit(1), end), "UTF-8"), F.lit("..."))).otherwise(text)
