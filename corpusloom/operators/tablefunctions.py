"""Functions that SQL can call: the parsers as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom.operators.facts import FACT, PARSERS, rows_of

_NAMES = [c.split()[0] for c in FACT.split(", ")]


@udtf(returnType=FACT, useArrow=True)
class SyntaxFacts:
    """syntax_facts(deep_language, content): the facts of one text; none where no parser knows the language, one error where it can't be read."""

    def eval(self, language: str, content: str) -> Iterator[tuple]:
        if language in PARSERS:
            for f in rows_of(PARSERS[language], content or ""):
                yield tuple(f.get(n) for n in _NAMES)


def register(spark: SparkSession) -> None:
    """From now on SQL knows syntax_facts."""
    spark.udtf.register("syntax_facts", SyntaxFacts)
