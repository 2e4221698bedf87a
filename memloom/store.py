"""MemoryStore: entities, claims and merge log as named tables with upsert, lookup and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions.text import name_key
from memloom.operators import browse, dedup


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` replace the table's rows of the same key."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns), allowMissingColumns=True)


class MemoryStore:
    def __init__(self, entities: DataFrame, claims: DataFrame, merge_log: DataFrame) -> None:
        self.entities, self.claims, self.merge_log = entities, claims, merge_log
        self.spark = entities.sparkSession

    def add_entity(self, rows: DataFrame) -> MemoryStore:
        self.entities = upsert(self.entities, rows)
        return self

    def add_claim(self, rows: DataFrame) -> MemoryStore:
        self.claims = upsert(self.claims, rows)
        return self

    def add_merge(self, rows: DataFrame) -> MemoryStore:
        self.merge_log = self.merge_log.unionByName(rows)
        return self

    def get_entity(self, id_: str):
        return self.entities.where(F.col("id") == id_).first()

    def get_claim(self, id_: str):
        return self.claims.where(F.col("id") == id_).first()

    def remove_entity(self, id_: str) -> MemoryStore:
        self.entities = self.entities.where(F.col("id") != id_)
        return self

    def remove_claim(self, id_: str) -> MemoryStore:
        self.claims = self.claims.where(F.col("id") != id_)
        return self

    def find_entities_by_name(self, needle: str) -> DataFrame:
        return browse.by_name(self.entities, needle)

    def get_claims_for_entity(self, id_: str) -> DataFrame:
        return browse.claims_of(self.claims, id_)

    def get_claims_between(self, a: str, b: str) -> DataFrame:
        return browse.claims_between(self.claims, a, b)

    def remove_orphan_entities(self) -> int:
        gone = dedup.orphans(self.entities, self.claims).count()
        self.entities = dedup.referenced(self.entities, self.claims)
        return gone

    def undo_merge(self, merge_id: str) -> bool:
        """Both sides back as they were before one merge; False if it is unknown, irreversible or without snapshots."""
        record = self.merge_log.where(F.col("id") == merge_id).first()
        if record is None or not record.reversible or record.original_snapshots is None:
            return False
        winner, loser = record.original_snapshots.winner, record.original_snapshots.loser
        if winner is None or loser is None:
            return False
        table = self.entities if record.merge_type == "entity" else self.claims
        both = self.spark.createDataFrame([(winner,), (loser,)], "json string")
        kept = F.from_json("json", table.schema)
        rows = both.select(kept.alias("r")).select("r.*")
        rows = table.join(rows.select("id"), "id", "left_semi").limit(0).unionByName(rows)
        if record.merge_type == "entity":
            self.entities = upsert(self.entities, rows)
            name = self.spark.createDataFrame([(loser,)], "json string").select(F.get_json_object("json", "$.name").alias("n"), F.get_json_object("json", "$.id").alias("i")).first()
            win = self.spark.createDataFrame([(winner,)], "json string").select(F.get_json_object("json", "$.id")).first()[0]
            own = name_key(F.lit(name.n))
            move = lambda side: F.when((F.col(f"{side}_id") == win) & (name_key(F.col(f"{side}_name")) == own), F.lit(name.i)).otherwise(F.col(f"{side}_id"))
            self.claims = self.claims.withColumns({"subject_id": move("subject"), "object_id": move("object")})
        else:
            self.claims = upsert(self.claims, rows)
        self.merge_log = self.merge_log.where(F.col("id") != merge_id)
        return True

    def to_snapshot(self, path: str, corpus_info: dict[str, str] | None = None) -> str:
        """A folder of Parquet tables and a one-row meta table."""
        for name in ("entities", "claims", "merge_log"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        info = {k: str(v) for k, v in (corpus_info or {}).items()}
        meta = self.spark.createDataFrame([(schemas.SCHEMA_VERSION, info)], "schema_version string, corpus_info map<string,string>")
        meta.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return path

    serialize = to_snapshot

    @classmethod
    def from_snapshot(cls, spark: SparkSession, path: str) -> MemoryStore:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("entities", "claims", "merge_log")])

    deserialize = from_snapshot
