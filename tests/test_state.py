"""Items in the state that pages carry in scripts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.sources import dom, state

NEXT = {"props": {"pageProps": {"a": {"b": {"Videos": [{"title": "T1", "url": "u1", "year": 20201231, "rating": 7.5, "thumb": {"src": "i"}}, {"name": "no url"}, 5]}}, "list": [{"id": 9, "name": "N", "url": None}, {"deep": {"x": [{"title": "D", "link": "https://d.net"}]}}]}}}
HTML = f"""<script id="__NEXT_DATA__" type="application/json">{json.dumps(NEXT)}</script>
<script>var a = 1; window.__NUXT__ = {{"s":"}}{{\\"","items":[{{"headline":"H","href":"h","desc":null,"duration":[1],"quality":true}}]}}; f({{}});</script><script>__NUXT__ = {{"items":[{{"title":"later","url":"x"}}]}}</script>
<script>window.__INITIAL_STATE__={{"x":{{"results":[{{"title":"S","slug":"s"}}]}}}};window.fooState = {{"entries":[{{"title":"E","id":1}}]}};</script><script>window.barState = {{broken}};window.__PRELOADED_STATE__ = [1];</script>"""


def test_state_items(spark):
    found = dom.elements(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>x</p>"), (4, "<script>window.aState = {</script>")], "page_id long, html string"))
    got = [tuple(r) for r in state.state_items(found).orderBy("place", "path").collect()]
    assert got == [
        (1, 0, "NextJS", "$.a.b.Videos[0]", "T1", "/u1", None, '{"src":"i"}', None, "2020", "7.5", None),
        # The first key that is there decides, a null one too.
        (1, 0, "NextJS", "$.list[0]", "N", "/null", None, None, None, None, None, None),
        (1, 0, "NextJS", "$.list[1].deep.x[0]", "D", "https://d.net", None, None, None, None, None, None),
        (1, 1, "NuxtJS", "$.items[0]", "H", "/h", "null", None, None, None, None, "true"),
        (1, 3, "SPA", "$.entries[0]", "E", "/1", None, None, None, None, None, None),
        (1, 3, "SPA", "$.x.results[0]", "S", "/s", None, None, None, None, None, None),
    ]


def brute(value, depth=0, path="$", most=5):
    """Items by the rule of the walk, on parsed JSON."""
    if depth > most:
        return []
    out = []
    for key, v in value.items():
        at = f"{path}.{key}"
        if isinstance(v, dict):
            out += brute(v, depth + 1, at, most)
        elif isinstance(v, list):
            for i, x in enumerate([x for x in v if isinstance(x, dict)]):
                if key.lower() in state.ARRAYS or len({k.lower() for k in x} & set(state.ITEM_KEYS)) >= 2:
                    # The first key that is there decides; an array is no text.
                    first = [next((x[k] for k in state.FIELDS[f] if k in x), []) for f in ("title", "url")]
                    if not any(isinstance(v, list) for v in first):
                        out.append(f"{at}[{i}]")
                else:
                    out += brute(x, depth + 1, f"{at}[{i}]", most)
    return out


@pytest.mark.parametrize("most", [5, 1])
def test_walk_equals_recursion(spark, most):
    rng = random.Random(8)
    keys = ["items", "Results", "x", "y", "title", "url", "name", "z", "data"]

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {k: value(depth - 1) for k in rng.sample(keys, rng.randint(0, 4))}
        if depth and kind < 0.8:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, "s", 2.5, True])

    trees = [{k: value(7) for k in rng.sample(keys, 4)} for _ in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(99, "[1]"), (100, "3")], "n long, j string")
    got = sorted((r["n"], r["path"]) for r in state.walk(rows.select("n", F.parse_json("j").alias("v")), most).collect())
    assert got == sorted((i, p) for i, t in enumerate(trees) for p in brute(t, most=most)) and got


def test_balanced_objects(spark):
    cases = [('{"a":{}} {}', '{"a":{}}'), ('{"a":"}"};', '{"a":"}"}'), (r'{"a":"\"}"}x', r'{"a":"\"}"}'), (r'{"a":"\\"}}', r'{"a":"\\"}'), ("{", None), ("x{}", None), ("", None), (None, None), ("{" * 300 + "}" * 300, "{" * 300 + "}" * 300)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, t string")
    assert [r[0] for r in rows.orderBy("n").select(state.balanced(F.col("t"))).collect()] == [c[1] for c in cases]
