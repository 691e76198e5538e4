"""Seed expansion as a table function: one seed, many rows, by a callable that stands for a model.

``expand_seed`` makes a Python table function for SQL: ``FROM expand_seed(TABLE(seeds) PARTITION BY (text, salt) ORDER BY id)``.
Rows of one text come together, so that the callable is asked once for each text and salt and not once for each row; the
salt cuts a text that many rows share into as many tasks as it has values. What the callable raises becomes the ``error``
of its rows; it stops neither the other rows nor the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from calltide.session import ship

SCHEMA = "id long, place int, item string, error string"
SALTS = 8


def expand_seed(model: Callable[[str], Iterable[str]]):
    """The table function over rows (id long, text string, salt int): SCHEMA, ``place`` counts a text's items from 0.

    A row without items gives none; a null text is not asked for and gives the error "no text".
    """

    class Expand:
        def __init__(self) -> None:
            self.text, self.answer = None, ([], "no text")

        def eval(self, row: Row) -> Iterator[tuple]:
            if row["text"] is not None and (row["text"] != self.text):
                self.text = row["text"]
                try:
                    self.answer = [str(x) for x in model(self.text)], None
                except Exception as e:  # noqa: BLE001  any failure of the callable is its rows' error
                    self.answer = [], f"{type(e).__name__}: {e}"
            items, error = self.answer if row["text"] is not None else ([], "no text")
            if error is not None:
                yield row["id"], None, None, error
            for place, item in enumerate(items):
                yield row["id"], place, item, None

    return F.udtf(Expand, returnType=SCHEMA)


def expand(seeds: DataFrame, seed_id: str, text: str, model: Callable[[str], Iterable[str]], salts: int = SALTS) -> DataFrame:
    """SCHEMA of every row of ``seeds``; ids are longs and may repeat."""
    spark = seeds.sparkSession
    ship(spark)
    spark.udtf.register("expand_seed", expand_seed(model))
    rows = seeds.select(F.col(seed_id).cast("long").alias("id"), F.col(text).alias("text"), F.pmod(F.xxhash64(seed_id), F.lit(salts)).cast("int").alias("salt"))
    return spark.sql("SELECT * FROM expand_seed(TABLE(SELECT * FROM {rows}) PARTITION BY (text, salt) ORDER BY id)", rows=rows)
