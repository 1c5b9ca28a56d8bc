"""Plans as chains of named SELECTs, and how they run on Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tempora.operators import index

FRAMES = ("statuses", "postings", "vectors", "doclen", "term_stats", "coll", "topics", "labels", "wiki", "samples")


class Plan:
    """Named SELECTs in order, then a final one. Index tables stand in braces, as in {postings}.

    A step that is ``cut`` has few rows (a result list, a vector, a selection) and is used again. Spark writes it once and
    goes on from the written rows, whose size it then knows; so later steps broadcast it and don't search again. Of a
    cut step, `IN (SELECT term FROM step)` and `IN (SELECT id FROM step)` become lists, which reach the scan of the index
    and skip files and row groups there. To other engines a cut step is like any other.
    """

    def __init__(self) -> None:
        self.steps: dict[str, str] = {}
        self.cuts: list[str] = []
        self.last = ""

    def add(self, name: str, sql: str) -> Plan:
        self.steps.setdefault(name, sql)
        return self

    def cut(self, *names: str) -> Plan:
        self.cuts += [n for n in names if n not in self.cuts]
        return self

    def then(self, sql: str) -> Plan:
        self.last = sql
        return self

    @property
    def frames(self) -> set[str]:
        return set(re.findall(r"\{(\w+)\}", self.text))

    @property
    def text(self) -> str:
        return self._with(self.steps, self.last)

    @staticmethod
    def _with(steps: dict[str, str], last: str) -> str:
        head = ",\n".join(f"{n} AS ({s})" for n, s in steps.items())
        return (f"WITH {head}\n" if head else "") + last

    def needed(self, last: str, known: set[str]) -> dict[str, str]:
        """The steps that ``last`` is made of, beyond those known."""
        read = lambda sql: {w for w in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql) if w in self.steps}
        wanted, open_ = set(), read(last)
        while open_:
            name = open_.pop()
            wanted.add(name)
            if name not in known:
                open_ |= read(self.steps[name]) - wanted
        return {n: s for n, s in self.steps.items() if n in wanted}


#: Values of a cut step that are written out as a list.
LIST = 1000


def run(spark: SparkSession, plan: Plan, frames: dict[str, DataFrame]) -> DataFrame:
    known: dict[str, DataFrame] = {}
    lists: dict[str, str] = {}

    def made(last: str) -> DataFrame:
        steps = {n: f"SELECT * FROM {{cut_{n}}}" if n in known else s for n, s in plan.needed(last, set(known)).items()}
        text = Plan._with(steps, last)
        for inner, values_ in lists.items():
            text = text.replace(inner, values_)
        every = frames | {f"cut_{n}": df for n, df in known.items()}
        return spark.sql(text, **{n: every[n] for n in set(re.findall(r"\{(\w+)\}", text))})

    rest = "\n".join([*plan.steps.values(), plan.last])
    reached = plan.needed(plan.last, set())
    for name in plan.steps:
        if name not in plan.cuts or name not in reached:
            continue
        path = index.shared_path(spark, "cut")
        step = made(f"SELECT * FROM {name}")
        step.coalesce(1).write.parquet(path)
        known[name] = spark.read.schema(step.schema).parquet(path)
        for column in ("term", "id"):
            if (inner := f"IN (SELECT {column} FROM {name})") in rest:
                found = [r[0] for r in known[name].select(column).distinct().limit(LIST + 1).collect()]
                if 0 < len(found) <= LIST:
                    lists[inner] = "IN (" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x) for x in sorted(found)) + ")"
    return made(plan.last)


def values(rows: list[tuple], names: str) -> str:
    """An inline table; numbers as doubles, whole ones as they are."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"{x!r}e0" if isinstance(x, float) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) AS t({names})"
