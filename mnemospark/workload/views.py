"""Memory tables derived from the driver's tables, whole tables and whole texts.

Each view exists twice: as a DataFrame here and as a common table expression in
``oracle_views``. Ids are numbers so that both engines order them alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NOW = datetime(2024, 1, 31)


class Views:
    """Lazy views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._read = spark, sf_dir, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        """A driver table; its zone-less times are UTC."""
        if name not in self._read:
            self._read[name] = self._load(name)
        return self._read[name]

    def _load(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        plain = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df

    def epi(self) -> DataFrame:
        """Episodes from the event log."""
        kind = F.col("event_type")
        none = F.lit(None)
        return self.table("events").select(
            F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 10).alias("project_id"),
            F.when(F.col("user_id") % 3 == 0, "go").when(F.col("user_id") % 3 == 1, "python").otherwise("").alias("language"),
            F.when(kind == "error", "debug").when(kind == "click", "feature").when(kind == "view", "review")
            .otherwise("refactor").alias("task_type"),
            F.concat(kind, F.lit(" "), F.col("props")).alias("summary"), F.lit("LLM").alias("source_type"),
            (1 + F.col("user_id") % 5).cast("int").alias("trust_level"),
            F.least(F.lit(1.0), F.col("value") / 100).alias("weight"), F.lit(1.0).alias("effective_frequency"),
            F.concat(F.lit("func:f"), F.col("user_id") % 20, F.lit(".py")).alias("entity_group"),
            none.cast("array<float>").alias("context_vector"), none.cast("string").alias("full_snapshot_uri"),
            (kind == "error").alias("is_correction"),
            F.when(kind == "error", 0.7).when(kind == "signup", 0.5).otherwise(0.0).alias("surprise_score"),
            F.col("ts").alias("created_at"), none.cast("timestamp").alias("last_accessed_at"),
            F.when(F.col("value") < 5, F.col("ts")).alias("obsoleted_at"), F.col("ts").alias("occurred_at"))

    @staticmethod
    def _marked(ident: str = "doc_id") -> Column:
        mark = F.when(F.col(ident) % 3 == 0, "never ").when(F.col(ident) % 3 == 1, "always ").otherwise("")
        return F.concat(mark, F.col("text"))

    @staticmethod
    def _minute(ident: str = "doc_id") -> Column:
        return F.timestamp_micros(F.lit(1704067200000000) + F.col(ident) * 60000000)  # 2024-01-01 + id minutes

    @staticmethod
    def _project() -> Column:
        return F.concat(F.lit("p"), F.coalesce(F.col("label"), F.col("doc_id") % 10))

    def vec(self) -> DataFrame:
        """All documents, with their vector where there is one, as episodes of the project of the label."""
        none = F.lit(None)
        lang = F.col("lang")
        joined = self.table("documents").join(self.table("embeddings"), F.col("vec_id") == F.col("doc_id"), "left")
        return joined.select(
            F.col("doc_id").alias("id"), self._project().alias("project_id"), lang.alias("language"),
            F.when(lang == "en", "debug").when(lang == "fr", "feature").when(lang == "de", "review")
            .otherwise("refactor").alias("task_type"),
            self._marked().alias("summary"), F.lit("LLM").alias("source_type"),
            (1 + F.col("doc_id") % 5).cast("int").alias("trust_level"),
            F.least(F.lit(1.0), F.col("n_chars") / 3000).alias("weight"), F.lit(1.0).alias("effective_frequency"),
            F.concat(F.lit("doc:"), F.col("doc_id") % 50).alias("entity_group"),
            F.col("embedding").alias("context_vector"), none.cast("string").alias("full_snapshot_uri"),
            F.lit(False).alias("is_correction"), ((F.col("doc_id") % 5) / 5).alias("surprise_score"),
            self._minute().alias("created_at"), none.cast("timestamp").alias("last_accessed_at"),
            F.when(F.col("n_chars") < 100, self._minute()).alias("obsoleted_at"), self._minute().alias("occurred_at"))

    def new(self) -> DataFrame:
        """Write events: every document again, slightly changed, so that all
        separation reasons, restatements and directive flips occur."""
        d = F.col("doc_id")
        swapped = F.when(d % 3 == 0, "always ").when(d % 3 == 1, "never ").otherwise("")
        kept = F.when(d % 3 == 0, "never ").when(d % 3 == 1, "always ").otherwise("")
        joined = self.table("documents").join(self.table("embeddings"), F.col("vec_id") == d, "left")
        return joined.select(
            (d + 1000000).alias("event_id"), d.alias("seq"), self._project().alias("project_id"),
            F.when(d % 5 == 0, "xx").otherwise(F.col("lang")).alias("language"), F.lit("debug").alias("task_type"),
            F.when(d % 7 == 0, "").when(d % 3 == 0, "doc:new").otherwise(F.concat(F.lit("doc:"), d % 50))
            .alias("entity_group"),
            F.concat(F.when(d % 2 == 0, swapped).otherwise(kept), F.col("text"), F.lit(" again")).alias("summary"),
            F.when(F.col("embedding").isNotNull(), F.concat(F.slice("embedding", 1, 56), F.array_repeat(F.lit(0.0).cast("float"), 8))).alias("context_vector"),
            (d % 6 == 0).alias("is_correction"), F.when(d % 6 == 0, 0.7).otherwise(0.0).alias("surprise_score"),
            F.when(d % 4 == 0, F.lit(datetime(2023, 12, 31))).otherwise(
                F.timestamp_micros(F.lit(1706745600000000) + d * 60000000)).alias("occurred_at"))

    def rule(self) -> DataFrame:
        """Directives from all documents, one project per source."""
        none = F.lit(None)
        return self.table("documents").select(
            F.col("doc_id").alias("id"), F.col("source").alias("project_id"),
            F.when(F.col("doc_id") % 2 == 0, "RULE").otherwise("CONSTRAINT").alias("type"),
            self._marked().alias("content"), F.lit("INFERRED").alias("source_type"),
            (1 + F.col("doc_id") % 5).cast("int").alias("trust_level"),
            F.least(F.lit(1.0), F.col("n_chars") / 3000).alias("weight"), F.lit(1.0).alias("effective_frequency"),
            F.concat(F.lit("rules:"), F.col("source")).alias("entity_group"), self._minute().alias("created_at"),
            F.when(F.col("n_chars") < 100, self._minute()).alias("obsoleted_at"),
            none.cast("array<string>").alias("source_episodic_ids"))

    def turn(self) -> DataFrame:
        """Conversation turns with confirmation and correction phrases."""
        n = F.col("conv_id") + F.col("turn")
        mark = F.when(n % 7 == 0, "remember this: ").when(n % 7 == 1, "that's wrong, ").when(n % 7 == 2, "继续：").otherwise("")
        key = F.col("conv_id") * 1000 + F.col("turn")
        return self.table("conversations").select(
            key.alias("event_id"), F.concat(F.lit("p"), F.col("conv_id") % 10).alias("project_id"), key.alias("seq"),
            F.col("conv_id").alias("session_id"), "role", F.concat(mark, F.col("text")).alias("content"),
            F.when(F.col("turn") % 3 == 0, "2024-01-15 10:00:00").when(F.col("turn") % 3 == 1, "2024-01-16T10:30:00Z")
            .otherwise("soon").alias("chat_time"))

    def pit(self) -> DataFrame:
        """Pitfalls from error events, one per user."""
        k = F.col("k")
        errors = self.table("events").filter(F.col("event_type") == "error").withColumn("k", F.col("user_id"))
        grouped = errors.groupBy("k").agg(
            F.count("*").alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first"), F.max("value").alias("top"),
            F.sum((F.col("value") < 20).cast("bigint")).alias("low"), F.min("event_id").alias("e1"),
            F.max("event_id").alias("e2"))
        vectors = self.table("embeddings").select(F.col("vec_id").alias("k"), "embedding")
        causes = ["CONCURRENCY", "RESOURCE_EXHAUSTION", "CONFIG", "CONTRACT_VIOLATION", "LOGIC_ERROR"]
        cause = F.lit("UNKNOWN")
        for i, name in enumerate(causes):
            cause = F.when(k % 6 == i, name).otherwise(cause)
        none = F.lit(None)
        return grouped.join(vectors, "k", "left").select(
            k.alias("id"), F.concat(F.lit("func:f"), k % 20, F.lit(".py")).alias("entity_id"),
            F.lit("FUNCTION").alias("entity_type"), F.concat(F.lit("p"), k % 10).alias("project_id"),
            F.lit("python").alias("language"), F.concat(F.lit("the timeout "), k, F.lit(" in module "), k % 5).alias("signature"),
            F.col("embedding").alias("signature_embedding"), cause.alias("root_cause_category"),
            F.concat(F.lit("raise limit "), k % 7).alias("fix_strategy"), (k % 3 == 0).alias("was_user_corrected"),
            F.col("n").cast("int").alias("occurrence_count"), F.col("last").alias("last_occurred_at"),
            F.lit("INFERRED").alias("source_type"), (1 + k % 5).cast("int").alias("trust_level"),
            F.least(F.lit(1.0), F.col("top") / 150).alias("weight"), F.col("first").alias("created_at"),
            F.col("last").alias("updated_at"), F.when(k % 13 == 0, F.col("last")).otherwise(none).alias("obsoleted_at"),
            F.array("e1", "e2", F.lit(-1).cast("bigint")).alias("source_episodic_ids"),
            F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "proposed").when(k % 4 == 2, "suppressed").otherwise("")
            .alias("status"), F.col("n").cast("int").alias("times_shown"), F.col("low").cast("int").alias("times_suppressed"),
            F.lit(0).alias("times_adopted"), (k % 4).cast("int").alias("protection_level"))

    def q(self) -> DataFrame:
        """Questions: benchmark texts with a borrowed vector and an entity reference."""
        i = F.col("item_id")
        joined = self.table("benchmark").join(self.table("embeddings"), i == F.col("vec_id"))
        return joined.select(
            i.alias("question_id"), F.concat(F.lit("p"), F.col("label")).alias("project_id"),
            F.concat(F.col("text"), F.lit(" see @f"), i % 20, F.lit(".py")).alias("query"),
            F.col("embedding").alias("query_vector"),
            F.when(i % 3 == 0, "en").when(i % 3 == 1, "fr").otherwise("").alias("language"),
            F.when(i % 2 == 0, "debug").otherwise("other").alias("task_type"),
            F.when(i % 2 == 0, F.concat(F.lit("func:f"), i % 20, F.lit(".py"))).otherwise("").alias("entity_id"))

    def edge(self) -> DataFrame:
        """Provenance edges from order lines."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("from_id"), (F.col("l_partkey") * 6).alias("to_id"),
            F.when(F.col("l_linenumber") % 2 == 1, "DERIVED_FROM").otherwise("RELATES_TO").alias("edge_type"))

    def correction(self) -> DataFrame:
        """Corrections from orders."""
        p = F.substring("o_orderpriority", 1, 1)
        return self.table("orders").select(
            F.col("o_orderkey").alias("correction_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"),
            F.when(p == "1", "episodic").when(p.isin("2", "3"), "pitfall").otherwise("semantic").alias("kind"),
            F.col("o_orderpriority").alias("corrected_to"), (F.col("o_orderstatus") == "F").alias("user_corrected"))

    def feedback(self) -> DataFrame:
        """Feedback from the event log, on the memories whose id is the user."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("user_id").alias("memory_id"), F.col("event_id").alias("seq"),
            F.when(kind == "error", "corrected").when(kind == "click", "used").when(kind == "view", "ignored")
            .when(kind == "signup", "confirmed").otherwise("liked").alias("action"))
