"""Query understanding by literal cases."""

from pyspark.sql import functions as F

from sieveworks.functions import language as L
from sieveworks.functions import querytext as N
from sieveworks.plans.language import LEXICON


def understood(spark, text, intent="VIDEO"):
    rows = spark.createDataFrame([(text,)], "text string").select(N.normal_query(F.col("text")).alias("q")).withColumn("t", N.query_tokens(F.col("q")))
    rows = rows.withColumn("c", L.concepts(F.col("t"), F.col("q"), LEXICON))
    tags = F.transform(L.tagged(F.col("t"), LEXICON), lambda w: w["class"])
    return rows.select("c", tags.alias("tags"), L.generated_queries(F.col("c"), F.lit(intent), LEXICON).alias("queries"), L.concept_terms(F.col("c"), LEXICON).alias("terms"), L.fingerprint(F.lit(intent), F.col("c")).alias("mark")).first()


def test_classes_and_concepts(spark):
    r = understood(spark, "show me the happy cat in an old house")
    assert r["tags"] == ["VERB", "PRONOUN", "DETERMINER", "ADJECTIVE", "NOUN", "PREPOSITION", "DETERMINER", "ADJECTIVE", "NOUN"]
    c = r["c"]
    assert c["subjects"] == ["cat", "house"] and c["actions"] == ["show"] and c["descriptors"] == ["happy", "old"]
    assert c["emotions"] == ["happy"] and c["contexts"] == ["home"] and c["compounds"] == ["old house", "happy cat"]
    assert r["mark"] == "VIDEO|cat,house|show"


def test_generated_queries(spark):
    r = understood(spark, "find cats")
    assert r["queries"] == [
        "cat find", "find cat", "cat search", "cat locate", "cat find compilation", "cat find funny", "best cat find", "cat find moments", "cat find reaction", "cat find video", "cat",
    ] or r["queries"][:2] == ["cat find", "find cat"]
    assert "cat search" in r["queries"] and "best cat find" in r["queries"] and len(r["queries"]) == len(set(r["queries"])) <= 20
    assert {"cat", "find", "search", "locate"} <= set(r["terms"])


def test_causes(spark):
    c = understood(spark, "dogs jumping and falling")["c"]
    assert [tuple(x) for x in c["causes"]] == [("jump", "fall")]
    assert understood(spark, "")["queries"] == []


def test_strategies_of_queries(spark):
    lexicon = L.Lexicon(nouns=("cat", "film"), verbs=("find",), thesaurus={"film": ("movie",)}, emotion_terms={"happy": ("joyful",)})
    empty = dict.fromkeys(("descriptors", "contexts"), [])
    c = {**empty, "subjects": ["film"], "actions": ["find"], "emotions": ["happy"], "compounds": ["short film"], "causes": [("jump", "fall")]}
    asked = ["A Short Film", "joyful thing", "jump then fall", "find a film", "a movie", "best guide", "film", "else"]
    schema = "c struct<subjects:array<string>,actions:array<string>,descriptors:array<string>,emotions:array<string>,contexts:array<string>,compounds:array<string>,causes:array<struct<cause:string,effect:string>>>, q string"
    rows = spark.createDataFrame([(c, q) for q in asked], schema)
    got = [r[0] for r in rows.select(L.query_strategy(F.col("q"), F.col("c"), lexicon)).collect()]
    assert got == ["compound", "emotion", "cause_effect", "core_concept", "synonym", "intent", "broad", "broad"]
