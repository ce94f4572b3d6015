"""Queries of query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.functions import language as L
from sieveworks.functions import querytext as N
from sieveworks.plans.registry import query
from sieveworks.sources import tables as T

#: A small application lexicon for the queries.
LEXICON = L.Lexicon(
    verbs=("show", "find", "make", "give", "tell", "write", "read", "open", "move"), nouns=("cat", "dog", "film"),
    thesaurus={"film": ("movie", "picture"), "find": ("search", "locate")}, compounds={"film": ("short film",)}, phrases=("old house",),
    emotions={"happy": ("happy", "glad")}, emotion_terms={"happy": ("joyful", "cheerful")}, contexts={"home": ("house", "kitchen")},
)


def _asked(spark, sf):
    c = T.table(spark, sf, "conversations").where("role = 'user'")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), N.normal_query(F.col("text")).alias("q"))
    return rows.withColumn("t", N.query_tokens(F.col("q")))


@query(f"""WITH f AS (SELECT unnest({list(dict.fromkeys(['stories', 'wolves', 'boxes', 'glasses', 'churches', 'dishes', 'cats', 'glass', 'gas', 'mice', 'trying', 'stopping', 'making', 'sing', 'dancing', 'tried', 'stopped', 'created', 'liked', 'walked', 'goes', 'went', 'bed']))}) AS w)
 SELECT w, CASE w WHEN 'stories' THEN 'story' WHEN 'wolves' THEN 'wolf' WHEN 'boxes' THEN 'box' WHEN 'glasses' THEN 'glass' WHEN 'churches' THEN 'church' WHEN 'dishes' THEN 'dish' WHEN 'cats' THEN 'cat' WHEN 'mice' THEN 'mouse' WHEN 'goes' THEN 'goe' ELSE w END AS noun,
 CASE w WHEN 'stories' THEN 'stori' WHEN 'wolves' THEN 'wolv' WHEN 'boxes' THEN 'box' WHEN 'glasses' THEN 'glass' WHEN 'churches' THEN 'church' WHEN 'dishes' THEN 'dish' WHEN 'cats' THEN 'cat' WHEN 'trying' THEN 'try' WHEN 'stopping' THEN 'stopp' WHEN 'making' THEN 'make' WHEN 'dancing' THEN 'dance'
  WHEN 'tried' THEN 'try' WHEN 'stopped' THEN 'stop' WHEN 'created' THEN 'create' WHEN 'liked' THEN 'like' WHEN 'walked' THEN 'walke' WHEN 'goes' THEN 'go' WHEN 'went' THEN 'go' ELSE w END AS verb FROM f""", views=False)
def nlp_bases(spark, sf):
    """Base forms by literal cases."""
    words = ("stories", "wolves", "boxes", "glasses", "churches", "dishes", "cats", "glass", "gas", "mice", "trying", "stopping", "making", "sing", "dancing", "tried", "stopped", "created", "liked", "walked", "goes", "went", "bed")
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("w"))
    return rows.select("w", L.noun_base(F.col("w")).alias("noun"), L.verb_base(F.col("w")).alias("verb"))


@query()
def nlp_classes(spark, sf):
    return _asked(spark, sf).select("ts", F.array_join(F.transform(L.tagged(F.col("t"), LEXICON), lambda w: F.concat_ws("/", w["word"], w["class"])), " ").alias("tags"))


@query()
def nlp_concepts(spark, sf):
    rows = _asked(spark, sf).select("ts", L.concepts(F.col("t"), F.col("q"), LEXICON).alias("c"), N.intent(F.col("t")).alias("intent"))
    joined = [F.array_join(F.col(f"c.{n}"), "|").alias(n) for n in ("subjects", "actions", "descriptors", "emotions", "contexts", "compounds")]
    return rows.select("ts", *joined, F.size("c.causes").alias("n_causes"), L.fingerprint(F.col("intent"), F.col("c")).alias("fingerprint"))


@query()
def nlp_queries(spark, sf):
    rows = _asked(spark, sf).select("ts", L.concepts(F.col("t"), F.col("q"), LEXICON).alias("c"), N.intent(F.col("t")).alias("intent"))
    return rows.select("ts", F.array_join(L.generated_queries(F.col("c"), F.col("intent"), LEXICON), "|").alias("queries"), F.array_join(L.concept_terms(F.col("c"), LEXICON), "|").alias("terms"))


@query()
def nlp_strategies(spark, sf):
    """How many of each search's generated queries each strategy likely made."""
    rows = _asked(spark, sf).select("ts", L.concepts(F.col("t"), F.col("q"), LEXICON).alias("c"), N.intent(F.col("t")).alias("intent"))
    each = rows.select("ts", "c", F.explode(L.generated_queries(F.col("c"), F.col("intent"), LEXICON)).alias("made"))
    return each.groupBy("ts", L.query_strategy(F.col("made"), F.col("c"), LEXICON).alias("strategy")).agg(F.count("*").alias("n"))
