"""Columns by schema: types, code tables in several languages, and names. Tables are plain dictionaries that callers give."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linenet.functions import text as X

CASTS = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class CodeTable:
    """code -> language -> (label, description)."""

    entries: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)

    def _of(self, place: int, language: str) -> dict[str, str]:
        return {code: by[language][place] for code, by in self.entries.items() if language in by}

    def label(self, code: Column, language: str) -> Column:
        """An unknown code is its own label."""
        return X.label(code, self._of(0, language))

    def description(self, code: Column, language: str) -> Column:
        table = F.create_map(*[F.lit(x) for kv in self._of(1, language).items() for x in kv])
        return F.try_element_at(table, X.code(code))

    def code(self, label: Column, language: str) -> Column:
        """The first code with this label; null of an unknown one."""
        back: dict[str, str] = {}
        for code, own in self._of(0, language).items():
            back.setdefault(own, code)
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in back.items() for x in kv]), label)


def standardize(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast by type (code, string, integer, float, boolean, datetime); what can't be cast is null, the empty text
    too; columns without a type stay."""

    def cast(name: str) -> Column:
        kind, column = types.get(name), F.col(f"`{name}`")
        text = F.nullif(column.cast("string"), F.lit(""))
        if kind is None:
            return column
        if kind == "code":
            return X.code(column).alias(name)
        if kind == "datetime":
            return F.try_to_timestamp(text).alias(name)
        if kind == "integer":
            return F.floor(text.try_cast("double")).cast("bigint").alias(name)
        return text.try_cast(CASTS[kind]).alias(name)

    return df.select(*[cast(c) for c in df.columns])


def expanded(df: DataFrame, tables: dict[str, CodeTable], language: str) -> DataFrame:
    return df.withColumns({c: t.label(F.col(c), language) for c, t in tables.items() if c in df.columns})


def renamed(df: DataFrame, names: dict[str, dict[str, str]], language: str) -> DataFrame:
    """names: column -> language -> name; a column without entry keeps its name."""
    return df.withColumnsRenamed({c: by[language] for c, by in names.items() if c in df.columns and language in by})


def process(df: DataFrame, types: dict[str, str], tables: dict[str, CodeTable], names: dict[str, dict[str, str]], language: str) -> DataFrame:
    """Types first, then labels for codes, then names."""
    return renamed(expanded(standardize(df, types), tables, language), names, language)


@dataclass(frozen=True)
class Bundle:
    """A dataset: layers with geometry (which share one reference system) and tables of attributes."""

    layers: dict[str, DataFrame]
    tables: dict[str, DataFrame]
    version: str
    language: str
    codes: dict[str, CodeTable] = field(default_factory=dict)

    def __post_init__(self):
        found = set()
        for layer in self.layers.values():
            found |= {r[0] for r in layer.select("srid").distinct().limit(3).collect()}
        if self.layers and (None in found or len(found) != 1):
            raise ValueError(f"layers must state one reference system: {found}")

    def layer_names(self) -> list[str]:
        return list(self.layers)

    def summary(self) -> DataFrame:
        """layer, n: rows of each; tables too."""
        out = None
        for name, df in {**self.layers, **self.tables}.items():
            row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), F.lit(name in self.layers).alias("spatial"), "n")
            out = row if out is None else out.unionByName(row)
        return out

    def description(self, column: str, label: Column) -> Column:
        """What a label means, by way of its code."""
        table = self.codes[column]
        return table.description(table.code(label, self.language), self.language)
