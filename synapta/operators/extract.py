"""Text to knowledge: rules, dictionaries, and the parsing of model answers. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.functions import text as X
from synapta.operators.joins import holding

# Phrases that begin a fact, its category and confidence.
FACT_RULES = (("i like |i prefer ", "preference", 0.8), ("my name is", "personal", 0.9), ("i plan |i want to ", "plan", 0.7))
# The names of the dictionary and their types.
DICTIONARY = (
    ("OpenAI", "Organization"), ("Google", "Organization"), ("Microsoft", "Organization"), ("NVIDIA", "Organization"), ("TSMC", "Organization"),
    ("GPT-4", "AIModel"), ("AlphaFold", "AIModel"), ("Demis Hassabis", "Person"), ("Sam Altman", "Person"), ("Sundar Pichai", "Person"),
)
DICTIONARY_CONFIDENCE = 0.85
KG_SCHEMA = (
    "entities array<struct<name:string,type:string,attributes:map<string,string>,confidence:double,temporal_relevance:string>>,"
    "relationships array<struct<subject:string,predicate:string,object:string,confidence:double,temporal_type:string>>,"
    "events array<struct<name:string,type:string,participants:array<string>,timestamp:string,confidence:double>>"
)
FACT_SCHEMA = "facts array<struct<content:string,category:string,confidence:double>>"


def rule_facts(messages: DataFrame) -> DataFrame:
    """(message_id, content, category, confidence): each rule's text from its phrase to the end."""
    low = F.lower("content")

    def fact(phrases, category, confidence):
        # Positions by the lower-cased text: the fact keeps its own case.
        at = F.length(F.regexp_extract(low, f"(?s)^(.*?)(?:{phrases})", 1))
        return F.when(low.rlike(phrases), F.struct(F.trim(F.substr("content", at + 1)).alias("content"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence")))

    found = F.filter(F.array(*[fact(*rule) for rule in FACT_RULES]), lambda f: f.isNotNull())
    return messages.select("message_id", F.explode(found).alias("f")).select("message_id", "f.*")


def rule_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, name): capitalized words of two bytes or more without trailing punctuation."""
    words = docs.select("doc_id", F.posexplode(X.words(F.col("content"))).alias("pos", "word"))
    name = F.regexp_replace("word", r"[!-/:-@\[-`{-~]+$", "")
    return words.select("doc_id", "pos", name.alias("name")).filter(F.col("name").rlike("^[A-Z]") & (F.octet_length("name") > 1))


def neighbours_related(entities: DataFrame) -> DataFrame:
    """Consecutive entities of a document are related, with confidence a half."""
    previous = F.lag("name").over(Window.partitionBy("doc_id").orderBy("pos"))
    return entities.select("doc_id", previous.alias("subject"), F.lit("related_to").alias("predicate"), F.col("name").alias("object"), F.lit(0.5).alias("confidence")).filter("subject IS NOT NULL")


def parse_json(text: Column, schema: str) -> Column:
    """The answer's JSON, whole or as its span from the first to the last brace."""
    return F.coalesce(F.from_json(X.json_span(text), schema))


def parse_facts(answers: DataFrame, least: float = 0.5) -> DataFrame:
    """(answer_id, i, content, category, confidence); a missing confidence is a half."""
    facts = answers.select("answer_id", F.posexplode(parse_json(F.col("text"), FACT_SCHEMA)["facts"]).alias("i", "f"))
    out = facts.select("answer_id", "i", F.coalesce("f.content", F.lit("")).alias("content"), F.coalesce("f.category", F.lit("unknown")).alias("category"), F.coalesce("f.confidence", F.lit(0.5)).alias("confidence"))
    return out.filter(F.col("confidence") >= least)


def parse_graph(answers: DataFrame, least: float = 0.5, most_entities: int = 20, most_relationships: int = 30) -> DataFrame:
    """Per answer: entities and relationships of enough confidence, events, and the overall confidence before limits apply."""
    g = answers.select("answer_id", parse_json(F.col("text"), KG_SCHEMA).alias("g"))
    keep = lambda n: F.filter(F.coalesce(F.col("g")[n], F.array()), lambda e: e["confidence"] >= least)
    mean = lambda c: F.when(F.size(c) == 0, 0.0).otherwise(F.aggregate(c, F.lit(0.0), lambda s, e: s + e["confidence"]) / F.size(c))
    kept = g.select("answer_id", keep("entities").alias("entities"), keep("relationships").alias("relationships"), keep("events").alias("events"))
    whole = kept.withColumn("confidence", (mean(F.col("entities")) + mean(F.col("relationships"))) / 2)
    return whole.withColumn("entities", F.slice("entities", 1, most_entities)).withColumn("relationships", F.slice("relationships", 1, most_relationships))


def event_times(parsed: DataFrame) -> DataFrame:
    """(answer_id, name, ts): null for a time that is no instant."""
    events = parsed.select("answer_id", F.explode("events").alias("e"))
    return events.select("answer_id", "e.name", F.try_to_timestamp("e.timestamp").alias("ts"))


def dictionary_entities(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name, entity_type, confidence) for every name (name, entity_type) that a text holds, in its case."""
    hits = holding(docs, "content", names, "name")
    return hits.select("doc_id", "name", "entity_type", F.lit(DICTIONARY_CONFIDENCE).alias("confidence"))


def extraction_jobs(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities and tokens of each document's extraction: bytes of the prompt and 50 an entity."""
    n = entities.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = docs.join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("doc_id", F.col("n").alias("entities"), (F.octet_length("content") + 50 * F.col("n")).cast("long").alias("tokens_used"))


def reload_memories(messages: DataFrame) -> DataFrame:
    """Messages worth keeping, once per normalised beginning: (message_id, importance, tags)."""
    told = messages.filter((F.lower("role") != "system") & (F.col("content") != ""))
    n = F.row_number().over(Window.partitionBy(F.substring(F.trim(F.lower("content")), 1, 100)).orderBy("message_id"))
    first = told.withColumn("_n", n).filter("_n = 1").filter(X.worth_keeping(F.col("content")))
    return first.select("message_id", "content", X.message_importance(F.col("content")).alias("importance"), X.message_tags(F.col("content")).alias("tags"))


def session_summary(messages: DataFrame, last: int = 20, part: int = 100, most: int = 500) -> DataFrame:
    """Per session the user's points worth keeping among its last messages, each and all cut to a length."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    text = F.trim("content")
    cut = F.when(F.length(text) > part, F.concat(F.substring(text, 1, part), F.lit("..."))).otherwise(text)
    recent = messages.withColumn("_n", n).filter(F.col("_n") <= last).filter((F.lower("role") == "user") & (text != "") & X.worth_keeping(text))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", cut.alias("p")))), lambda x: x["p"]), " ")
    whole = recent.groupBy("session_id").agg(joined.alias("s"))
    return whole.select("session_id", F.when(F.length("s") > most, F.concat(F.substring("s", 1, most), F.lit("..."))).otherwise(F.col("s")).alias("summary"))


def prompt(text: Column, system: str, sections: dict[str, str], stage: str, examples: tuple[tuple[str, str], ...] = ()) -> Column:
    """A staged extraction prompt: system, titled sections, the stage's task, two examples at most, the text, the request."""
    parts = [system, *[f"## {title}\n\n{body}" for title, body in sections.items()], stage]
    parts += [f"### Example {i}\n**Input**: {a}\n\n**Output**:\n```json\n{b}\n```" for i, (a, b) in enumerate(examples[:2], 1)]
    return F.concat(F.lit("\n\n".join(parts) + "\n\n## Text\n\n"), text, F.lit("\n\n---\nAnswer with the JSON only."))
