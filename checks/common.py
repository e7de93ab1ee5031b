"""Registry: a query, the columns it shows, and the SQL that must give the same rows.

One column list is applied to both sides: ``name`` as it is, ``name~`` rounded to 6 places,
``name~3`` to 3, ``name$`` as text, ``name#`` as a 64-bit integer. Before rounding a small fixed shift
moves exact decimal ties, which engines round differently, off the boundary.
"""

import re

from pyspark.sql import functions as F

from halocline.sources.driver_tables import MAPPINGS, mapped

QUERIES = {}
ORACLES = {}
TABLES = {f"t_{name}": text for name, text in MAPPINGS.items()}
SHIFT = 2.37e-4


def parse(columns):
    for token in columns.split():
        m = re.fullmatch(r"(\w+)(?:(~)(-?\d+)?|(\$)|(#))?", token)
        name, tilde, places, text, integer = m.groups()
        yield name, ("round", int(places or 6)) if tilde else ("text", 0) if text else ("int", 0) if integer else ("same", 0)


def shown(df, columns):
    out = []
    for name, (kind, places) in parse(columns):
        c = F.col(name)
        if kind == "round":
            c = F.round(c + F.lit(SHIFT * 10.0**-places), places) + F.lit(0.0)
        elif kind in ("text", "int"):
            c = c.cast({"text": "string", "int": "bigint"}[kind])
        out.append(c.alias(name))
    return df.select(*out)


def shown_sql(sql, columns):
    out = []
    for name, (kind, places) in parse(columns):
        text = {
            "round": f"round({name} + {SHIFT * 10.0**-places!r}, {places}) + 0.0",
            "text": f"CAST({name} AS VARCHAR)",
            "int": f"CAST({name} AS BIGINT)",
            "same": name,
        }[kind]
        out.append(f"{text} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS shown_rows"


def with_tables(sql):
    """Prefix the named tables that a text needs, in order of use."""
    order = []

    def visit(text):
        for name in dict.fromkeys(re.findall(r"\bt_\w+", text)):
            if name in TABLES and name not in order:
                visit(TABLES[name])
                order.append(name)

    visit(sql)
    parts = ", ".join(f"{n} AS ({TABLES[n]})" for n in order)
    return f"WITH {parts} {sql}" if parts else sql


def query(name, columns, sql=None):
    """Register ``fn(m)``, where ``m(table)`` gives a mapped table and ``m.spark``, ``m.dir`` the rest."""

    def register(fn):
        def run(spark, sf_dir):
            df = fn(Mapped(spark, sf_dir))
            return shown(df, columns)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = shown_sql(sql, columns)
        return fn

    return register


def oracles():
    """Complete oracle texts; built after all named tables are known."""
    return {name: with_tables(sql) for name, sql in ORACLES.items()}


class Mapped:
    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name):
        return mapped(self.spark, self.dir, name)

    def raw(self, name):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
