import pytest
import regex as unicode_re
from pyspark.sql import functions as F

from casework.rules import labels
from casework.rules.engine import anchor, fixed_words, regex, split_window
from casework.rules.label_maps import LEVEL_0, SUB_TYPE_SCHEMES
from casework.rules.verdict_pack import VERDICT_BLOCKS
from tests.goldens import CASE_TYPES, FOUR_CLASS_FORMS, GROUPS, SUB_TYPES, VERDICTS


def test_case_type_goldens(spark):
    df = spark.createDataFrame(CASE_TYPES, "text string, expected string")
    rows = labels.with_case_type(df, "text").collect()
    assert [r.case_type for r in rows] == [r.expected for r in rows]


def test_sub_type_goldens(spark):
    df = spark.createDataFrame(SUB_TYPES, "text string, case_type string, expected string")
    rows = labels.with_sub_type(df, "text").collect()
    assert [r.sub_type for r in rows] == [r.expected for r in rows]


def test_tie_goes_to_first_type(spark):
    # 'plea' (civil, 2) against 'debt' (contract, 2)
    df = spark.createDataFrame([("plea of debt",), ("nothing here",)], "text string")
    assert [r.case_type for r in labels.with_case_type(df, "text").collect()] == [
        "Civil Procedure",
        "Unclassified",
    ]


def test_early_scheme(spark):
    df = spark.createDataFrame(
        [("trespass on the case",), ("the goods were sold",), ("he stole a horse, larceny",)], "text string"
    )
    df = labels.with_case_type(df, "text", early=True)
    rows = labels.with_sub_type(df, "text", early=True).collect()
    assert [(r.case_type, r.sub_type) for r in rows] == [
        ("Torts", "Trespass"),
        ("Property Law - Execution Sale", "General Execution"),
        ("Criminal Law", "Larceny"),
    ]


def test_verdict_goldens(spark):
    df = spark.createDataFrame(VERDICTS, "text string, expected string")
    rows = labels.with_verdict(df, "text", block_out="block").collect()
    assert [r.verdict for r in rows] == [r.expected for r in rows]


def test_windows_limit_the_rules(spark):
    filler = "x" * 3000
    df = spark.createDataFrame(
        [("the bill is dismissed. " + filler,), (filler + " the bill is dismissed.",)], "text string"
    )
    # Outside the last 2500 characters only the whole-text rules see it.
    assert [r.verdict for r in labels.with_verdict(df, "text").collect()] == [
        "Verdict Unknown",
        "Bill Dismissed",
    ]


def test_anchor_is_always_in_a_match():
    assert anchor("judgment is directed for the plaintiffs?") == "plaintiff"
    assert anchor("(?:judgment|decree) is (affirmed|reversed)") == "is"
    assert anchor("a|b") == ""
    assert fixed_words("award o[f]? (?:the )?sum x{2}y") == ["award", "o", "sum", "y"]
    for _, _, rules in VERDICT_BLOCKS:
        for r in rules:
            for p in r.patterns:
                assert anchor(p) in regex(p)
                unicode_re.compile(regex(p))


def test_gates_cover_every_rule():
    for name, gate, rules in VERDICT_BLOCKS:
        for r in rules if gate else []:
            needed = [[split_window(h)[1]] for h in r.has] + ([list(r.has_any)] if r.has_any else [])
            by_text = any(all(any(g in t for g in gate) for t in texts) for texts in needed)
            by_pattern = bool(r.patterns) and all(
                any(g in w for g in gate for w in fixed_words(p)) for p in r.patterns
            )
            assert by_text or by_pattern, (name, r)


def test_verdict_groups(spark):
    df = spark.createDataFrame(GROUPS, "verdict string, expected string")
    rows = df.withColumn("g", labels.verdict_group(F.col("verdict"))).collect()
    assert [r.g for r in rows] == [r.expected for r in rows]


def test_four_class_forms(spark):
    df = spark.createDataFrame(FOUR_CLASS_FORMS, "verdict string, expected string")
    assert labels.rule_failures(df, "verdict", "expected").count() == 0
    row = labels.verify_rules(df, "verdict", "expected").first()
    assert (row.total, row.passed, row.accuracy) == (len(FOUR_CLASS_FORMS), len(FOUR_CLASS_FORMS), 100.0)
    assert labels.unmapped_keywords(labels.with_four_class(df, "verdict")).count() == 0


def test_ocr_steps(spark):
    forms = [
        ("Per Curiam: The Judgment Js REVERSED", "PER CURIAM: THE JUDGMENT IS REVERSED"),
        ("Per Curiam: The Judgment'Is- REVERSED", "PER CURIAM: THE JUDGMENTIS REVERSED"),
        ("Costs /That &C. Tíre", "COSTS THAT ETC. THE"),
        ("", ""),
        (None, ""),
    ]
    df = spark.createDataFrame(forms, "v string, expected string")
    rows = df.withColumn("out", labels.clean_ocr(F.col("v"))).collect()
    assert [r.out for r in rows] == [r.expected for r in rows]


@pytest.mark.parametrize("scheme", list(SUB_TYPE_SCHEMES))
def test_sub_type_schemes(spark, scheme):
    df = spark.createDataFrame([(n,) for n in [*LEVEL_0, "Nonsense", None]], "s string")
    rows = {r.s: r.m for r in df.withColumn("m", labels.merge_sub_type(F.col("s"), scheme)).collect()}
    assert rows["Nonsense"] == rows[None] == "OTHER"
    assert rows["Larceny"] in ("CRIMINAL_OFFENSE", "PROPERTY_CRIME")
    assert rows["Appeal"] in ("APPELLATE_PROCEDURE", "PROCEDURAL")
    assert all(rows[n] != "OTHER" for n in LEVEL_0)


def test_hierarchy(spark):
    df = spark.createDataFrame([("Appeal",), ("Larceny",), ("Bond",), ("?",)], "s string")
    rows = df.select(*[c.alias(n) for n, c in labels.hierarchy_labels(F.col("s")).items()]).collect()
    assert [tuple(r) for r in rows] == [
        ("CIVIL", "CIVIL", "APPELLATE", None),
        ("CRIMINAL", "CRIMINAL", None, "SPECIFIC_OFFENSE"),
        ("CONTRACT", None, None, None),
        ("OTHER", None, None, None),
    ]


def test_lookup_join_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, k string")
    table = spark.createDataFrame([("a", "A")], "k string, v string")
    out = labels.lookup_join(df, table, "k", "v", "label", "none").orderBy("id").collect()
    assert [r.label for r in out] == ["A", "none", "none"]


def test_feature_check():
    labels.check_features(["text", "court"], ["keyword"])
    with pytest.raises(ValueError):
        labels.check_features(["text", "keyword"], ["keyword"])


def test_every_verdict_rule_has_a_text_that_it_decides(spark):
    """Each rule stands as a block of its own, so that the deciding rule is told apart, and then in its block."""
    from casework.rules.engine import first_match
    from casework.rules.verdict_pack import UNKNOWN_VERDICT, VERDICT_BLOCKS
    from checks.verdict_goldens import VERDICT_GOLDENS

    assert {name: len(rules) for name, _, rules in VERDICT_BLOCKS} == {name: len(g) for name, g in VERDICT_GOLDENS.items()}
    rows = [(f"{name}.{k}", text, label) for name, g in VERDICT_GOLDENS.items() for k, (text, label) in enumerate(g)]
    df = spark.createDataFrame(rows, "rule string, text string, expected string")
    single = [(f"{name}.{k}", gate, [r]) for name, gate, rules in VERDICT_BLOCKS for k, r in enumerate(rules)]
    found = first_match(df, F.col("text"), single, "verdict", UNKNOWN_VERDICT, "decided").collect()
    assert [r for r in found if (r.rule, r.expected) != (r.decided, r.verdict)] == []
    found = labels.with_verdict(df, "text", block_out="block").collect()
    assert [r for r in found if (r.rule.split(".")[0], r.expected) != (r.block, r.verdict)] == []
