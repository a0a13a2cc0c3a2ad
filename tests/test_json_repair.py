"""Repair of cut-off and careless JSON objects, as expressions."""

import json

import pytest
from pyspark.sql import functions as F

from tendermill.functions import text

CASES = [
    ('Voici : {"a": {"b": "x}"}} et {"c": 1}', {"a": {"b": "x}"}}), ('{"a": [1, 2,],}', {"a": [1, 2]}), ('{"a": "non fermé', {"a": "non fermé"}), ('{"q": "\\"}", "n": 2} fin', {"q": '"}', "n": 2}),
    ('{"a": 1', {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": {"b": [{"c": "d', {"a": {"b": [{"c": "d"}]}}), ('{"a": ', {"a": ""}), ('{"a"', {"a": ""}), ("{", {}), ('{"a": 1,', {"a": 1}),
    ("{a: 1, b_c: true}", {"a": 1, "b_c": True}), ("{'a': 'l\\'été', 'b': 'dit \"oui\"'}", {"a": "l'été", "b": 'dit "oui"'}), ('{"a": True, "b": None, "c": FALSE}', {"a": True, "b": None, "c": False}),
    ('{"a": deux mots, "b": 2}', {"a": "deux mots", "b": 2}), ('{"a" 1 "b": 2}', {"a": 1, "b": 2}), ('{"a": [1 , , 2]}', {"a": [1, 2]}),
    ('{"a": [{"b": 1}, {"b": 2}', {"a": [{"b": 1}, {"b": 2}]}), ('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": {"b": 1], "c": 2}', {"a": {"b": 1, "c": 2}}), ('{"a": "deux\nlignes\tet"}', {"a": "deux\nlignes\tet"}),
    ('{"a": 01, "b": -1.5e3, "c": .5}', {"a": "01", "b": -1500.0, "c": ".5"}), ('{"a": "x\\', {"a": "x"}), ('{"a": "x\\u00', {"a": "x"}), ('{"a": "\\\\"}', {"a": "\\"}), ("```json\n{\"a\": 1}\n```", {"a": 1}),
    ('{"a": , "b": 2}', {"a": "", "b": 2}), ('{"requirements": [{"exigence": "Kbis", "obligatoire": true}, {"exigence": "Attest', {"requirements": [{"exigence": "Kbis", "obligatoire": True}, {"exigence": "Attest"}]}),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", text.lenient_json(F.col("t"), '{"none": 1}').alias("j")).collect()}
    wrong = [(CASES[i], got[i]) for i in got if json.loads(got[i]) != CASES[i][1]]
    assert not wrong, wrong


def test_texts_without_an_object_give_the_skeleton(spark):
    df = spark.createDataFrame([("rien",), ("",), (None,), ("[1, 2]",)], "t string")
    assert {r.j for r in df.select(text.lenient_json(F.col("t"), '{"none": 1}').alias("j")).collect()} == {'{"none": 1}'}


WHOLE = {"criteres": [{"nom": "Prix \"HT\"", "poids": 40.5}, {"nom": "Délai\\", "poids": None}], "infos": {"lots": [1, 2, [3]], "vide": {}, "ok": False}, "fin": "été"}


@pytest.mark.parametrize("step", [0, 1])
def test_every_prefix_of_an_object_parses_and_keeps_what_is_whole(spark, step):
    raw = json.dumps(WHOLE, ensure_ascii=bool(step), indent=step or None)
    df = spark.createDataFrame([(n, raw[:n]) for n in range(1, len(raw) + 1)], "n int, t string")
    got = {r.n: json.loads(r.j) for r in df.select("n", text.repaired_json(F.col("t")).alias("j")).collect()}
    assert got[len(raw)] == WHOLE and len(got) == len(raw)
    sizes = [len(json.dumps(got[n])) for n in sorted(got)]
    assert all(b >= a - 12 for a, b in zip(sizes, sizes[1:]))
    assert all(got[n]["criteres"][0] == WHOLE["criteres"][0] for n in got if n > raw.index('"Délai' if not step else '"D\\u00e9lai'))


def _closed(raw: str) -> str | None:
    """The first object by walking over each character."""
    at = raw.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(at, len(raw)) if at >= 0 else ():
        ch = raw[i]
        if ch == '"' and not escaped:
            quoted = not quoted
        elif not quoted and ch in "{}":
            depth += 1 if ch == "{" else -1
            if depth == 0:
                return raw[at : i + 1]
        escaped = quoted and not escaped and ch == "\\"
    return None


def test_first_objects_equal_a_walk_over_characters(spark):
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice('{}{}""\\a,:\n[]é😀 \'') for _ in range(draw.randrange(40))) for _ in range(3000)] + ['x {"a": "' + "b" * 200_000 + '"} }', "{" * 300 + "}" * 300 + "}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.o for r in df.select("i", text.first_object(F.col("t")).alias("o")).collect()}
    assert [texts[i] for i in got if got[i] != _closed(texts[i])] == []


def test_long_strings_are_closed(spark):
    """Strings of any length take no stack: before, some thousand characters overflowed it."""
    long = "mot 'cité' " * 20_000
    df = spark.createDataFrame([(0, '{"a": "' + long), (1, '{"a": "' + long + '", "b": [1'), (2, "{'a': '" + "x\\'" * 60_000)], "i int, t string")
    got = {r.i: json.loads(r.j) for r in df.select("i", text.lenient_json(F.col("t"), "{}").alias("j")).collect()}
    assert got == {0: {"a": long}, 1: {"a": long, "b": [1]}, 2: {"a": "x'" * 60_000}}
