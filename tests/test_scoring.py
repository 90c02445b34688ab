import json

import pytest
from pyspark.sql import functions as F

from assayer.functions.ids import dataset_id, eval_id, uuid5_hex
from assayer.functions.json_text import canonical_dumps, canonical_json, quote, redact_json, strict_json, strict_loads
from assayer.functions.text import WHITESPACE, casefold, label_key, nonblank, strip
from assayer.operators import scoring
from assayer.operators.scoring import ScorerError, evaluate, prepare

TABLE = [
    # whole texts: no trimming, folding beyond lower case
    ("exact_match", {"expected": "7 apples"}, "7 apples", True),
    ("exact_match", {"expected": "7 apples"}, "7 apples ", False),
    ("exact_match", {"expected": "7 Apples"}, "7 apples", False),
    ("exact_match", {"expected": "STRASSE", "case_sensitive": False}, "straße", True),
    ("exact_match", {"expected": ""}, "", True),
    # anywhere in the text
    ("contains", {"substring": "b"}, "abc", True),
    ("contains", {"substring": "x"}, "X", False),
    ("contains", {"substring": "GROSS", "case_sensitive": False}, "sehr groß!", True),
    ("contains", {"substring": "a.c"}, "abc", False),
    # searched, not matched whole; named groups and Unicode case as in Python
    ("regex", {"pattern": r"[0-9]{3}$"}, "room 204", True),
    ("regex", {"pattern": r"^[0-9]{3}$"}, "room 204", False),
    ("regex", {"pattern": r"(?P<n>a)b"}, "cab", True),
    ("regex", {"pattern": "é", "case_sensitive": False}, "É", True),
    # strict JSON: numbers must be finite, keys may repeat, nothing may follow
    ("json_validity", {}, "[null, -0.5]", True),
    ("json_validity", {}, '"text"', True),
    ("json_validity", {}, "[Infinity]", False),
    ("json_validity", {}, "-2e400", False),
    ("json_validity", {}, '{"a":1,"a":2}', True),
    ("json_validity", {}, '{"a":1} x', False),
    ("json_validity", {}, "", False),
    # keys of the top level of an object
    ("required_keys", {"keys": ["x", "y"]}, '{"y":null,"x":0,"z":1}', True),
    ("required_keys", {"keys": ["x", "y"]}, '{"x":{"y":1}}', False),
    ("required_keys", {"keys": ["x"]}, '["x"]', False),
    ("required_keys", {"keys": [" x "]}, '{"x":1}', True),
]
COLUMNS = {
    "exact_match": lambda o, c: scoring.exact_match(o, F.lit(c["expected"]), c.get("case_sensitive", True)),
    "contains": lambda o, c: scoring.contains(o, c["substring"], c.get("case_sensitive", True)),
    "regex": lambda o, c: scoring.regex(o, c["pattern"], c.get("case_sensitive", True)),
    "json_validity": lambda o, c: scoring.json_validity(o),
    "required_keys": lambda o, c: scoring.required_keys(o, c["keys"]),
}


@pytest.mark.parametrize(("name", "config", "output", "passed"), TABLE)
def test_one_output(name, config, output, passed):
    assert evaluate(prepare(name, config), output)[0] is passed


def test_columns_agree_with_single_outputs(spark):
    rows = spark.createDataFrame([(t[2],) for t in TABLE], "output string")
    outputs = [r.output for r in rows.collect()]
    for name, config, _, _ in TABLE:
        got = [r[0] for r in rows.select(COLUMNS[name](F.col("output"), config)).collect()]
        assert got == [evaluate(prepare(name, config), o)[0] for o in outputs], (name, config)


@pytest.mark.parametrize(
    ("name", "config"),
    [("other", {}), ("contains", {"substring": " "}), ("regex", {"pattern": "["}), ("required_keys", {"keys": ["a", " a "]}), ("required_keys", {"keys": []}), ("json_validity", {"x": 1}), ("exact_match", {}), ("exact_match", {"expected": "a", "case_sensitive": 1})],
)
def test_faulty_scorers(name, config):
    with pytest.raises(ScorerError):
        prepare(name, config)


def test_cases(spark):
    two = [("exact_match", json.dumps({"expected": "a"})), ("contains", json.dumps({"substring": "a"}))]
    kind = "eval_id string, evaluation_mode string, reference_answer string, scorers array<struct<name:string,config:string>>"
    cases = spark.createDataFrame([("d", "deterministic", None, two), ("r", "reference", "x", None), ("j", "rubric", None, None)], kind)
    outputs = spark.createDataFrame([("baseline", "d", "ab"), ("baseline", "r", "x"), ("candidate", "r", "X"), ("baseline", "j", "")], "role string, eval_id string, output string")
    rows = {(r.role, r.eval_id): (r.score, r.passed, len(r.results)) for r in scoring.score_cases(cases, outputs).collect()}
    assert rows == {("baseline", "d"): (0.5, False, 2), ("baseline", "r"): (1.0, True, 1), ("candidate", "r"): (0.0, False, 1)}


def test_text_functions(spark):
    texts = ["  a b \t", "", None, WHITESPACE, "Straße", "ﬁ", " Kelvin-sign ", "İ", "ΣΑΣ", "\x1ca\x85", "中文"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"), casefold(F.col("t")).alias("c"), label_key(F.col("t")).alias("k"), nonblank(F.col("t")).alias("n")).collect()
    for r in rows:
        if r.t is None:
            assert (r.s, r.c, r.k, r.n) == (None, None, None, False)
        else:
            assert (r.s, r.c, r.n) == (r.t.strip(), r.t.casefold(), bool(r.t.strip()))
    assert rows[5].k == "fi" and rows[6].k == "kelvin-sign"


def test_json_functions(spark):
    texts = ['{"b":1.0,"a":[1,{"é":"x"}]}', "NaN", "1e999", "[1] 2", '{"a":1,"a":2}', None, '"\\u0001"', "[" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json(F.col("t")).alias("c"), strict_json(F.col("t")).alias("s")).collect()
    assert rows[0].c == '{"a":[1,{"é":"x"}],"b":1.0}' and rows[0].s["keys"] == ["b", "a"]
    assert [r.s["valid"] for r in rows] == [True, False, False, False, True, None, True, False]
    quoted = ['a"b\\c', "é\n\t\x01", "plain", "", None]
    got = [r[0] for r in spark.createDataFrame([(q,) for q in quoted], "t string").select(quote(F.col("t"))).collect()]
    assert got == [None if q is None else json.dumps(q, ensure_ascii=False) for q in quoted]
    with pytest.raises(ValueError, match="repeated"):
        strict_loads('{"a":1,"a":1}', unique_keys=True)
    held = {"Auth": {"x": 1}, "list": [{"my_token": 1, "ok": 2}], "plain": "token"}
    clean = spark.createDataFrame([(json.dumps(held),), ("{",), (None,)], "t string").select(redact_json("t")).collect()
    assert [r[0] for r in clean] == [canonical_dumps({"Auth": "[redacted]", "list": [{"my_token": "[redacted]", "ok": 2}], "plain": "token"}), "[redacted]", None]


def test_ids(spark):
    import uuid

    names = ["a", 'q"\\', "é\n", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5_hex(str(uuid.NAMESPACE_URL), F.col("n")).alias("u"), eval_id(F.lit("d"), F.col("n")).alias("e")).collect()
    for r in rows:
        assert r.u == uuid.uuid5(uuid.NAMESPACE_URL, r.n).hex
        assert r.e == "eval_" + uuid.uuid5(uuid.UUID("b272f60f-9f27-5152-a2d5-80e6e4e77341"), canonical_dumps(["d", r.n])).hex
    assert dataset_id(" a ", "1") == dataset_id("a", " 1 ") != dataset_id("a", "2")
