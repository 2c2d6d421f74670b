"""Registry of named queries with the SQL each is checked against."""

from dataclasses import dataclass
from textwrap import dedent
from typing import Callable

from rentroll.sources.tables import Tables

REGISTRY = {}


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple
    build: Callable
    oracle: str | None

    def __call__(self, spark, sf_dir):
        return self.build(Tables(spark, sf_dir))


def query(name, covers, oracle=None):
    """Register ``build(tables) -> DataFrame``; ``covers`` lists the survey ids it answers."""

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, dedent(oracle).strip() if oracle else None)
        return build

    return register
