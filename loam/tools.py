"""The store's tools by name: every command of the tool interface as a method that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import dynamics as D
from loam.functions import vector as V
from loam.operators import graph, vectors
from loam.operators import store as S
from loam.sources import readers

TABLES = {
    "wings": "id string, name string, description string",
    "rooms": "id string, wing_id string, name string, description string",
    "drawers": "id string, room_id string, title string, content string, embedding array<float>",
    "kg": "edge_seq long, from_id string, to_id string, relation string, confidence double, ts long, success double, traversal double, recency double",
    "deposits": "drawer_id string, tag string, value double, decay double, strategy string",
    "agents": "id string, name string",
    "diary": "agent_id string, seq long, text string, ts long",
}


class ToolError(ValueError):
    """A call that names no tool, or refers to what is not there."""


class Store:
    """Tables and the tools over them; each write replaces a table by a new snapshot."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark = spark
        self.t = {n: tables.get(n, spark.createDataFrame([], s)) for n, s in TABLES.items()}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Store:
        return cls(spark, **readers.import_tables(spark, path, list(TABLES)))

    def save(self, path: str) -> None:
        readers.export_tables(path, **self.t)

    def call(self, tool: str, **args) -> DataFrame:
        found: Callable | None = getattr(self, f"tool_{tool}", None)
        if found is None:
            raise ToolError(f"unknown tool {tool}")
        return found(**args)

    @classmethod
    def tools(cls) -> list[str]:
        return sorted(n.removeprefix("tool_") for n in dir(cls) if n.startswith("tool_"))

    def _row(self, **cols) -> DataFrame:
        return self.spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in cols.items()])

    def _embed(self, text: str) -> list[float]:
        return list(self._row(t=text).select(V.hashed_ngram_udf()("t").alias("e")).first()[0])

    def _need(self, table: str, key: str) -> None:
        if self.t[table].where(F.col("id") == key).isEmpty():
            raise ToolError(f"no {key} in {table}")

    # reads
    def tool_status(self) -> DataFrame:
        return S.status(**self.t)

    def tool_list_wings(self) -> DataFrame:
        return self.t["wings"].orderBy("name")

    def tool_list_rooms(self, wing_id: str) -> DataFrame:
        return self.t["rooms"].where(F.col("wing_id") == wing_id)

    def tool_get_taxonomy(self) -> DataFrame:
        return S.taxonomy(self.t["wings"], self.t["rooms"], self.t["drawers"])

    def tool_search(self, query: str, top_k: int = 10) -> DataFrame:
        top = self.t["deposits"].groupBy(F.col("drawer_id").alias("id")).agg(F.max("value").alias("ph"))
        rows = self.t["drawers"].join(top, "id", "left")
        q = F.array(*[F.lit(x) for x in self._embed(query)])
        return vectors.hybrid_search(rows, query, q, top_k, "id", "title", "content", F.col("embedding"), F.coalesce("ph", F.lit(0.0)))

    def tool_find_similar(self, drawer_id: str, top_k: int = 10) -> DataFrame:
        return vectors.similar_to(self.t["drawers"], drawer_id, top_k)

    def tool_graph_stats(self) -> DataFrame:
        return self.t["kg"].agg(F.count("*").alias("n_edges"), F.count_if(F.col("relation") == "similar").alias("n_similar"), F.countDistinct("relation").alias("n_relations"))

    def tool_navigate(self, start: str, goal: str, max_steps: int = 20) -> DataFrame:
        """The path as rows (pos, id); navigate_all() of one query."""
        q = self.spark.createDataFrame([(0, start, goal)], "qid long, start string, goal string")
        top = self.t["deposits"].groupBy(F.col("drawer_id").alias("id")).agg(F.max("value").alias("value"))
        found = graph.navigate_all(q, self.t["kg"], self.t["drawers"].select("id", "embedding"), top, max_steps)
        return found.select(F.posexplode("path").alias("pos", "id"))

    # writes
    def tool_add_wing(self, name: str, description: str = "") -> DataFrame:
        self.t["wings"] = S.insert_wings(self.t["wings"], self._row(seq=0, name=name, description=description))
        return self._row(name=name).select(S.wing_id(F.col("name")).alias("id"))

    def tool_add_room(self, wing_id: str, name: str, description: str = "") -> DataFrame:
        self._need("wings", wing_id)
        self.t["rooms"], _ = S.insert_rooms(self.t["rooms"], self.t["wings"], self._row(seq=0, wing_id=wing_id, name=name, description=description))
        return self._row(w=wing_id, name=name).select(S.room_id(F.col("w"), F.col("name")).alias("id"))

    def tool_add_drawer(self, room_id: str, title: str, content: str) -> DataFrame:
        self._need("rooms", room_id)
        before = self.t["drawers"]
        self.t["drawers"], _ = S.insert_drawers(before, self.t["rooms"], self._row(seq=0, room_id=room_id, title=title, content=content))
        return self.t["drawers"].join(before.select("id"), "id", "left_anti").select("id")

    def tool_check_duplicate(self, room_id: str, content: str, threshold: float = 0.85) -> DataFrame:
        here = self.t["drawers"].where(F.col("room_id") == room_id)
        return vectors.top_k(here, self._embed(content), 1).where(F.col("score") > threshold)

    def tool_add_drawer_if_unique(self, room_id: str, title: str, content: str, threshold: float = 0.85) -> DataFrame:
        found = self.tool_check_duplicate(room_id, content, threshold)
        if found.isEmpty():
            return self.tool_add_drawer(room_id, title, content).withColumn("is_new", F.lit(True))
        return found.select("id", F.lit(False).alias("is_new"))

    def tool_kg_add(self, from_id: str, to_id: str, relation: str, confidence: float = 1.0) -> DataFrame:
        self.t["kg"] = S.kg_append(self.t["kg"], self._row(seq=0, from_id=from_id, to_id=to_id, relation=relation, confidence=float(confidence)))
        return self.tool_kg_query(from_id)

    def tool_kg_add_temporal(self, from_id: str, to_id: str, relation: str, ts: int = 0) -> DataFrame:
        self.t["kg"] = S.kg_append(self.t["kg"], self._row(seq=0, from_id=from_id, to_id=to_id, relation=relation, ts=F.lit(ts).cast("long")))
        return self.tool_kg_query(from_id)

    def tool_kg_query(self, from_id: str) -> DataFrame:
        return S.kg_query(self.t["kg"], from_id)

    def tool_kg_contradictions(self, threshold: float = 1.0) -> DataFrame:
        return S.contradictions(self.t["kg"], threshold)

    def tool_kg_invalidate(self, node: str) -> DataFrame:
        self.t["kg"] = S.kg_invalidate(self.t["kg"], node)
        return self.t["kg"].agg(F.count("*").alias("n_kg"))

    def _edges(self, made: DataFrame) -> DataFrame:
        from pyspark.sql import Window as W

        self.t["kg"] = S.kg_append(self.t["kg"], made.withColumn("seq", F.row_number().over(W.orderBy("from_id", "to_id")) - 1))
        return made

    def _vectors(self) -> DataFrame:
        d = self.t["drawers"].join(self.t["rooms"].select(F.col("id").alias("room_id"), "wing_id"), "room_id", "left")
        return d.select(F.xxhash64("id").alias("k"), "id", "embedding", F.coalesce("wing_id", F.lit("")).alias("wing"))

    def _pairs(self, threshold: float, relation: str, group: str | None) -> DataFrame:
        v = self._vectors()
        p = vectors.pairs(v.select(F.col("k").alias("id"), "embedding", "wing"), threshold, group=group)
        names = v.select("k", "id")
        j = p.join(names.withColumnsRenamed({"k": "a", "id": "x"}), "a").join(names.withColumnsRenamed({"k": "b", "id": "y"}), "b")
        return j.select(F.least("x", "y").alias("from_id"), F.greatest("x", "y").alias("to_id"), F.lit(relation).alias("relation"), F.col("cosine").alias("confidence"))

    def tool_build_similarity_graph(self, threshold: float = 0.5) -> DataFrame:
        return self._edges(self._pairs(threshold, "similar", None))

    def tool_build_tunnels(self, threshold: float = 0.3) -> DataFrame:
        return self._edges(self._pairs(threshold, "tunnel", "wing"))

    def tool_deposit_pheromones(self, drawer_id: str, value: float = 0.5, decay: float = 0.05, tag: str = "default") -> DataFrame:
        old = self.t["deposits"]
        new = S.deposit(old.select("drawer_id", "tag", "value"), self._row(seq=F.lit(0).cast("long"), drawer_id=drawer_id, tag=tag, amount=float(value)), self.t["drawers"])
        kept = old.select("drawer_id", "tag", F.col("decay").alias("__d"), F.col("strategy").alias("__s"))
        self.t["deposits"] = new.join(kept, ["drawer_id", "tag"], "left").select("drawer_id", "tag", "value", F.coalesce("__d", F.lit(decay)).alias("decay"), F.coalesce("__s", F.lit("exponential")).alias("strategy"))
        return self.t["deposits"].where(F.col("drawer_id") == drawer_id)

    def tool_decay_pheromones(self) -> DataFrame:
        self.t["deposits"], self.t["kg"] = S.tick(self.t["deposits"], self.t["kg"])
        return self.tool_pheromone_status()

    def tool_hot_paths(self, top_k: int = 10, tag: str | None = None) -> DataFrame:
        return S.hot_paths(self.t["deposits"], top_k, tag)

    def tool_cold_spots(self, threshold: float = 0.1, top_k: int = 10) -> DataFrame:
        return S.cold_spots(self.t["drawers"], self.t["deposits"], threshold, top_k)

    def tool_pheromone_status(self) -> DataFrame:
        return S.average_pheromone(self.t["drawers"], self.t["deposits"]).crossJoin(self.t["deposits"].agg(F.count("*").alias("n_deposits")))  # one row each

    def tool_create_agent(self, agent_id: str, name: str = "", archetype: str = "explorer") -> DataFrame:
        if archetype not in D.ARCHETYPES:
            raise ToolError(f"unknown archetype {archetype}")
        self.t["agents"], self.t["diary"] = S.upsert_agents(self.t["agents"], self.t["diary"], self._row(id=agent_id, name=name))
        return self.t["agents"].where(F.col("id") == agent_id)

    def tool_diary_write(self, agent_id: str, text: str, ts: int = 0) -> DataFrame:
        self._need("agents", agent_id)
        top = self.t["diary"].where(F.col("agent_id") == agent_id).agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
        new = self._row(agent_id=agent_id, seq=F.lit(top).cast("long"), text=text, ts=F.lit(ts).cast("long"))
        self.t["diary"], _ = S.append_diary(self.t["diary"], self.t["agents"], new)
        return new

    def tool_diary_read(self, agent_id: str, n: int = 10) -> DataFrame:
        return S.diary_recent(self.t["diary"].where(F.col("agent_id") == agent_id), n)
