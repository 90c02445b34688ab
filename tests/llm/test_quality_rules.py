import re
from collections import Counter

from assayer.llm import quality_rules as qr


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


EXTRA = ["a b c " * 40, "a b c d a b c x y z " * 3, "aa bb cc aa bb cc bb cc", "\n\n x\n x\nx\n", "#*$%&|<> " * 30, "🎉 é " * 60, "w " * 49, "w" + " x y" * 24 + " z q", "same same same same " + " ".join(f"w{i}" for i in range(80)), "\x1c\x1d a\x0bb\x0cc"]


def test_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + i, t) for i, t in enumerate(EXTRA)]
    got = {r.doc_id: r for r in qr.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(t), t
        assert not (r.base_failed and r.kept)


def test_rules_compile_to_bounds(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    rules = (qr.Rule("x", least=1.0), qr.Rule("x", most=2.0))
    assert [r.x for r in rows.filter(qr.compile_rules(rules)).collect()] == [1.5]


def test_verdicts(spark):
    clean = ("The house of the man is on the hill and it was as old as this tree, by all that is known to us. " * 1 + " ".join(f"Word{i}, and it is {i} of them." for i in range(20)))
    junk = " ".join(f"thing{i}$$$" for i in range(80))
    loud = " ".join(f"THE{i}!!" for i in range(80))
    listed = " | ".join(f"thing{i}" for i in range(80))
    got = [r.kept for r in qr.digest(spark.createDataFrame(list(enumerate([clean, junk, loud, listed])), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [True, False, False, False]


def test_odd_rows(odd, empty):
    assert qr.digest(odd).count() == odd.count() and qr.digest(empty).count() == 0
    clash = qr.apply_rules(odd.withColumnRenamed("size", "n_words"))
    assert clash.columns.count("n_words") == 1 and clash.columns.count("kept") == 1


def test_main_path_is_native_and_has_no_shuffle(documents):
    plan = qr.digest(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
