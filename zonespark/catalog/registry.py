"""Named queries over the derived tables and, where SQL can say the same, the SQL that says it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonespark import fixtures
from zonespark.plans.ordering import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The same queries as functions of Tables, for callers that have the views stored already.
BUILDERS: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made, self._stored = spark, sf_dir, {}, set()

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.view(self._spark, self._dir, name, self._made)

    def write(self, *names: str) -> None:
        """Write views out before they are used, as the stored tables they stand for."""
        for name in names:
            self._made[name] = materialise(getattr(self, name))
            self._stored.add(name)

    def dealt(self, view: str, by: str, table: str, key: str, parts: int) -> DataFrame:
        """A view over so many parts, dealt out `by` a column. If it is not stored, the rows of the table it is made from are dealt out by their key: they
        may be far shorter."""
        if view in self._stored:
            return getattr(self, view).repartition(parts, by)
        return fixtures.view(self._spark, self._dir, view, {table: getattr(self, table).repartition(parts, key)})


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), ctes: str = "", recursive: bool = False):
    """Register a function of Tables under a name. `sql` follows the views and further CTEs it needs."""

    def register(build: Callable[[Tables], DataFrame]):
        BUILDERS[name] = build
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            if views:
                ORACLES[name] = fixtures.with_views(*views) + (f",{ctes}\n" if ctes else "") + sql
            else:
                ORACLES[name] = (f"WITH {ctes}\n" if ctes else "") + sql
            if recursive:
                ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)
        return build

    return register
