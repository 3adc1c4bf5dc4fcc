"""The engine: dialect statements become DataFrame plans, everything else is Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.functions import models, vectors
from quern.operators import snapshot, store, update
from quern.plans import statements as S


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        vectors.register_all(spark)

    def sql(self, text: str, persist: bool = False, on_multiple: str = "error", order: str | None = None) -> DataFrame:
        """Runs one statement.  UPDATE gives the matched relation, or with ``persist`` replaces the table and gives it."""
        s, spark = S.parse(text), self.spark
        if isinstance(s, S.UpdateFrom):
            return update.update(spark, s, persist, on_multiple, order)
        if isinstance(s, S.DeleteFrom):
            return update.delete(spark, s)
        if isinstance(s, S.MakeSnapshot):
            return snapshot.make(spark, s)
        if isinstance(s, S.Restore):
            return snapshot.restore(spark, s)
        if isinstance(s, S.TrainModel):
            return models.train(spark, s)
        if isinstance(s, S.RegisterModel):
            return models.register(spark, s)
        if isinstance(s, S.Predict):
            return models.predict(spark, s)
        if isinstance(s, S.LoadData):
            return store.load(spark, s.path, s.table, s.overwrite, s.partition)
        if isinstance(s, S.DeployModel):
            return models.deploy(spark, s)
        return spark.sql(s.text)

    def merged(self, text: str, on_multiple: str = "error", order: str | None = None) -> DataFrame:
        """The target table, or its named partitions, as an UPDATE leaves it."""
        return update.merged(self.spark, S.parse(text), on_multiple, order)

    def recover(self, table: str) -> str:
        """Ends a replacement of a table that broke off."""
        return store.recover(self.spark, table)

    def remaining(self, text: str) -> DataFrame:
        """The rows that a DELETE leaves."""
        return update.remaining(self.spark, S.parse(text))
