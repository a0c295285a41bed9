"""Tables on disk: versioned store, message and operation logs, ontology, dialogue sets, Markdown objects, sinks."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
# Rows of the ontology file that are its template.
TEMPLATE_ROWS = ("一级分类", "---------")


class Store:
    """Versioned tables below a directory: immutable folders of Parquet, and manifests that say which of them a version reads.

    A transaction writes its folders first and commits by one rename of the next manifest, so it shows
    whole, for all of its tables, or not at all. An append adds a folder and rewrites nothing. One
    writer at a time; readers always see a committed state.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *[p for p in parts if p]]))

    @classmethod
    def init(cls, spark: SparkSession, path: str) -> Store:
        store = cls(spark, path)
        if store._commits():
            raise FileExistsError(path)
        store._commit(0, {"schema": SCHEMA_VERSION, "tables": {}})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        store = cls(spark, path)
        if not store._commits():
            raise FileNotFoundError(path)
        if (version := store._manifest()["schema"]) != SCHEMA_VERSION:
            raise ValueError(f"schema version {version} is not {SCHEMA_VERSION}")
        return store

    def _commits(self) -> list[int]:
        at = self._path("_commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self) -> dict:
        file = self._fs.open(self._path("_commits", f"{self._commits()[-1]:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _commit(self, number: int, manifest: dict) -> None:
        aside, final = self._path("_commits", f"_{uuid.uuid4().hex}"), self._path("_commits", f"{number:012d}.json")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise OSError(f"commit {number} was made by another writer")

    def versions(self, table: str) -> list[int]:
        return list(range(1, len(self._manifest()["tables"].get(table, [])) + 1))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        known = self._manifest()["tables"].get(table)
        if not known or version is not None and not 1 <= version <= len(known):
            raise FileNotFoundError(table if version is None else f"{table} version {version}")
        at, folders = version or len(known), []
        while at:  # an append names the version that it adds to
            folders += known[at - 1]["folders"]
            at = known[at - 1]["after"]
        paths = [f"{self.path}/{table}/{f}" for f in reversed(folders)]
        if not known[(version or len(known)) - 1]["by"]:
            return self.spark.read.parquet(*paths)
        # Partitioned folders have roots of their own.
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in paths])

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """A new version that is ``df`` alone."""
        return self.transaction({table: df}, partition_by)[table]

    def append(self, table: str, df: DataFrame) -> int:
        """A new version with the rows of ``df`` besides the last one's, partitioned as those are."""
        return self.transaction({table: df}, append=True)[table]

    def restore(self, table: str, version: int) -> int:
        """A new version with the rows of an earlier one; copies nothing."""
        self.read(table, version)
        manifest, number = self._manifest(), self._commits()[-1] + 1
        versions = manifest["tables"][table]
        versions.append({"folders": [], "after": version, "by": versions[version - 1]["by"]})
        self._commit(number, manifest)
        return len(versions)

    def transaction(self, tables: dict[str, DataFrame], partition_by: tuple[str, ...] = (), append: bool = False) -> dict[str, int]:
        """Write all tables, then commit them together; on failure what was written goes."""
        manifest, number, written, done = self._manifest(), self._commits()[-1] + 1, [], {}
        try:
            for name, df in tables.items():
                versions, folder = manifest["tables"].setdefault(name, []), f"d-{uuid.uuid4().hex}"
                by = versions[-1]["by"] if append and versions else list(partition_by)
                written.append(self._path(name, folder))
                df.write.partitionBy(*by).parquet(f"{self.path}/{name}/{folder}")
                versions.append({"folders": [folder], "after": len(versions) if append else 0, "by": by})
                done[name] = len(versions)
            self._commit(number, manifest)
        except BaseException:
            for path in written:
                self._fs.delete(path, True)
            raise
        return done


def save_graph(store: Store, entities: DataFrame, relationships: DataFrame) -> dict[str, int]:
    """Both tables of a knowledge graph, committed together."""
    return store.transaction({"entities": entities, "relationships": relationships})


def load_graph(store: Store) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) as last saved; FileNotFoundError for a store without a graph."""
    return store.read("entities"), store.read("relationships")


# Columns of the server's metadata tables.
METADATA = {
    "users": "id string, name string, avatar string, created_at timestamp, settings string",
    "settings": "id int, llm string, embedding string, server string, kg_extraction string, updated_at timestamp",
    "sessions": "id string, user_id string, name string, session_type string, model string, store_path string, created_at timestamp, updated_at timestamp, message_count int, tags string",
}


def init_metadata(store: Store, settings: DataFrame) -> None:
    """Empty users and sessions, and one row of settings; what is there already stays."""
    new = {n: store.spark.createDataFrame([], s) for n, s in METADATA.items() if n != "settings" and not store.versions(n)}
    if not store.versions("settings"):
        new["settings"] = settings.limit(1)
    if new:
        store.transaction(new)


def add_sessions(store: Store, sessions: DataFrame) -> int:
    """Adds or replaces sessions by id; of a session whose user is unknown the rows are refused."""
    known = sessions.join(store.read("users").select(F.col("id").alias("user_id")), "user_id", "left_semi").select(*sessions.columns)
    old = store.read("sessions")
    return store.write("sessions", old.join(known.select("id"), "id", "left_anti").select(*old.columns).unionByName(known.select(*old.columns)))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """The vector index (session_id, doc_id, vector) on disk, a folder per session: a session's search reads that alone."""
    vectors.repartition("session_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy("session_id").parquet(path)


def load_vectors(spark: SparkSession, path: str, session: object = None) -> DataFrame:
    """The global index, or that of one session (empty for an unknown one)."""
    saved = spark.read.parquet(path)
    return saved if session is None else saved.filter(F.col("session_id") == F.lit(session))


def message_index(messages: DataFrame) -> DataFrame:
    """Byte offset and length of every message in its session's log."""
    size = F.octet_length("content").cast("long")
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return messages.select("session_id", "message_id", "role", size.alias("byte_length"), F.coalesce(F.sum(size).over(w), F.lit(0)).alias("byte_offset"))


def session_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.sum(F.floor(F.length("content") / 4).cast("long")).alias("token_count"))


def point_lookup(memories: DataFrame, memory_id: int) -> DataFrame:
    """The memory in the first tier that holds it: working, short, long."""
    order = F.when(F.col("tier") == "working", 0).when(F.col("tier") == "short", 1).otherwise(2)
    return memories.filter(F.col("memory_id") == memory_id).orderBy(order).limit(1)


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the one of the largest version (insert or replace)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return versions.withColumn("_n", n).filter("_n = 1").drop("_n")


def missing(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` whose key is not known yet."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def filter_operations(ops: DataFrame, kinds: list[str], start: str | None = None, end: str | None = None, limit: int = 0) -> DataFrame:
    hits = ops.filter(F.col("op_kind").isin(*kinds)) if kinds else ops
    if start:
        hits = hits.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        hits = hits.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return hits.orderBy("ts", "op_id").limit(limit) if limit > 0 else hits


def trace(ops: DataFrame, kind: str, limit: int) -> DataFrame:
    """The first ``limit`` operations, and of these the ones of a kind: the filter follows the limit."""
    return ops.orderBy("ts", "op_id").limit(limit).filter(F.col("op_kind") == kind)


def scan_messages(messages: DataFrame, text: str, mode: str = "hybrid") -> DataFrame:
    """Substring or pattern hits with the constant score of their mode and a snippet of 200 characters."""
    # Scores by mode.
    score = {"text": 1.0, "hybrid": 0.8, "regex": 0.9, "semantic": 0.7, "memory": 0.8}[mode]
    hit = F.col("content").rlike("(?i)" + text) if mode == "regex" else F.lower("content").contains(text.lower())
    return messages.filter(hit).select("*", F.lit(score).alias("score"), F.substring("content", 1, 200).alias("snippet"))


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("op_id string, ts timestamp, op_kind string, op_name string, input string, output string, duration_ms long, tokens_used int").json(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_dialogues(spark: SparkSession, path: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(A file of one JSON list, or with ``whole`` false a sample a line.) Turns and questions of a nested dialogue set: {sample_id, sessions: [[{speaker, text, dia_id}]], qa: [...]}."""
    turn = "struct<speaker:string,text:string,dia_id:string>"
    schema = f"sample_id string, sessions array<array<{turn}>>, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", whole).json(path)
    sessions = raw.select("sample_id", F.posexplode("sessions").alias("session_no", "turns"))
    turns = sessions.select("sample_id", "session_no", F.posexplode("turns").alias("turn_no", "t")).select("sample_id", "session_no", "turn_no", "t.*")
    return turns, raw.select("sample_id", F.explode("qa").alias("q")).select("sample_id", "q.*")


def read_ontology(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Ontology entries with ids; template rows are skipped."""
    from synapta.functions.text import slugify

    raw = spark.read.schema("top_category string, first_category string, second_category string, chinese_name string, english_name string, overview string").option("multiLine", whole).json(path)
    ids = F.concat_ws("-", *[slugify(F.col(c)) for c in ("top_category", "first_category", "second_category")])
    return raw.filter(~F.col("first_category").isin(*TEMPLATE_ROWS)).withColumn("id", ids)


# The schema that a category of the ontology gets.
DOMAINS = {
    ("领域情报类", "科技情报", "人工智能"): "ai", ("领域情报类", "科技情报", "半导体芯片"): "semiconductor", ("领域情报类", "产业情报", None): "industry",
    ("要素情报类", "组织情报", None): "organization", ("要素情报类", "人物追踪", None): "person",
}


def domain(ontology: DataFrame) -> DataFrame:
    """Adds the domain whose schema an entry takes."""
    out = F.lit("generic")
    for (top, first, second), name in DOMAINS.items():
        hit = (F.col("top_category") == top) & (F.col("first_category") == first)
        out = F.when(hit & (F.col("second_category") == second) if second else hit, name).otherwise(out)
    return ontology.withColumn("domain", out)


def to_markdown(frontmatter: Column, content: Column) -> Column:
    return F.concat(F.lit("---\n"), F.to_json(frontmatter), F.lit("\n---\n\n"), content)


def from_markdown(text: Column, schema: str) -> Column:
    """Struct (frontmatter, content); null frontmatter for a text without a valid one."""
    part = lambda i: F.regexp_extract(text, r"(?s)^---\s*(.*?)\s*---\s*(.*)$", i)
    return F.struct(F.from_json(F.nullif(part(1), F.lit("")), schema).alias("frontmatter"), part(2).alias("content"))


def find_category(ontology: DataFrame, top: str, first: str | None = None, second: str | None = None) -> DataFrame:
    """Entries of a category, as far as it is given."""
    for column, value in (("top_category", top), ("first_category", first), ("second_category", second)):
        if value is not None:
            ontology = ontology.filter(F.col(column) == value)
    return ontology
