import pytest
from pyspark.sql import functions as F

from descry.operators import facts as facts_ops
from descry.operators import narrative

FACTS = (
    "report_id string, ordinal bigint, id string, kind string, denominator bigint, values map<string,double>, "
    "sentence string, allowed_interpretation_codes array<string>"
)
BLOCKS = (
    "response_id string, report_id string, language string, block_no int, section_id string, "
    "fact_ids array<string>, interpretation_code string, prose string"
)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [
            ("r", 1, "large", "numeric", 10, {"mean": 2.5}, "The verified mean was 2.50.", ["describe_direction"]),
            ("r", 2, "small", "group", 3, {"group_n": 3.0}, "Small cell.", []),
            ("other", 1, "elsewhere", "numeric", 9, {"mean": 1.0}, "Not here [[FACT:large]].", []),
        ],
        FACTS,
    )


def block(response, prose, fact_ids=(), code=None, language="en", no=1):
    return (response, "r", language, no, "interpretation", list(fact_ids), code, prose)


CASES = {
    "number": (block("number", "The mean was 2.50."), ["literal_quantitative_claim"]),
    "banned": (block("banned", "It was Statistically Significant."), ["unsupported_claim"]),
    "unknown": (block("unknown", "[[FACT:unknown]]"), ["unknown_fact"]),
    "other_report": (block("other_report", "[[FACT:elsewhere]]"), ["unknown_fact"]),
    "unresolved": (block("unresolved", "[[FACT:large"), ["unresolved_token"]),
    "good": (block("good", "Observed pattern: [[FACT:large]]", ["large"], "describe_direction"), []),
    "token_is_not_list": (block("token_is_not_list", "Seen: [[FACT:large]]", [], "describe_direction"), ["unsupported_interpretation"]),
    "code_alone": (block("code_alone", "Seen.", [], "describe_direction"), ["unsupported_interpretation"]),
    "wrong_code": (block("wrong_code", "Seen: [[FACT:large]]", ["large"], "linear_association"), ["unsupported_interpretation"]),
    "listed_unknown": (block("listed_unknown", "Seen.", ["nothing"]), ["unknown_fact"]),
    "empty": (block("empty", " \n\t", ["nothing"], "describe_direction"), ["empty_prose"]),
    "language": (block("language", "Hyvin.", language="fi"), ["wrong_language"]),
    "broken_beside_good": (block("broken_beside_good", "[[FACT:large]] and [[FACT:x"), []),
    "inside_word": (block("inside_word", "Phase2 and item_3 stay, x]4 too."), []),
    "unicode_digit": (block("unicode_digit", "About ٣ people."), ["literal_quantitative_claim"]),
    "several": (block("several", "7 cases were caused by [[FACT:none]]"), ["literal_quantitative_claim", "unknown_fact", "unsupported_claim"]),
}


@pytest.mark.parametrize("partitions", [1, 7])
def test_verdicts(spark, facts, partitions):
    blocks = spark.createDataFrame([case[0] for case in CASES.values()], BLOCKS).repartition(partitions)
    got = {r["response_id"]: (r["errors"], r["valid"]) for r in narrative.validate_narratives(blocks, facts, "en").collect()}
    assert got == {name: (errors, not errors) for name, (_, errors) in CASES.items()}


@pytest.mark.parametrize(
    "prose,number",
    [
        ("7", True), ("-7", True), ("a-7", True), ("a7", False), ("_7", False), ("]7", False), ("7a", True), ("x7 8", True),
        ("a1.5", True), ("é5", False), ("数5", False), ("½5", False), ("+٣", True), ("none", False), ("", False), ("[[FACT:a1]]", False),
        ("[[FACT:a1]]7", True), ("a[[FACT:b]]7", False), ("(7)", True), ("1,5%", True),
    ],
)
def test_literal_numbers(spark, prose, number):
    from descry.functions import text

    full = F.rlike(text.without_fact_tokens(F.lit(prose)), F.lit(text.LITERAL_NUMBER))
    row = spark.range(1).select(text.has_literal_number(F.lit(prose)), full).head()
    assert (row[0], row[1]) == (number, number)


def test_banned_terms_follow_the_expected_language(spark, facts):
    blocks = spark.createDataFrame([block("a", "Eso causó mejoras.", language="es")], BLOCKS)
    row = narrative.validate_narratives(blocks, facts, "es").head()
    assert row["errors"] == ["unsupported_claim"]
    row = narrative.validate_narratives(blocks, facts, F.lit("xx")).head()
    assert row["errors"] == ["wrong_language"]


def test_broken_tokens_are_reported_apart(spark):
    prose = ["[[FACT:large]] and [[FACT:x", "[[FACT:large]]", "none"]
    df = spark.createDataFrame([(p,) for p in prose], "prose string")
    assert [r[0] for r in df.select(narrative.has_broken_token(F.col("prose"))).collect()] == [True, False, False]


def test_errors_of_all_blocks_meet_in_one_verdict(spark, facts):
    blocks = spark.createDataFrame([block("a", "[[FACT:large]]"), block("a", "2 more", no=2), block("a", "  ", no=3)], BLOCKS)
    rows = narrative.validate_narratives(blocks, facts, "en").collect()
    assert [r["errors"] for r in rows] == [["empty_prose", "literal_quantitative_claim"]]


def test_unknown_facts_are_listed(spark, facts):
    blocks = spark.createDataFrame([block("a", "[[FACT:x]] [[FACT:large]] [[FACT:x]]", ["small", "y"])], BLOCKS)
    got = {r["fact_id"] for r in narrative.unknown_facts(blocks, facts).collect()}
    assert got == {"x", "y"}


def test_expansion_is_single_pass_and_drops_unknown(spark, facts):
    rows = [
        block("a", "Observed: [[FACT:large]]"),
        block("b", "[[FACT:large]][[FACT:nope]] end [[FACT:small]]", no=2),
        block("c", "No token."),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = {r["response_id"]: r["text"] for r in narrative.expand_fact_tokens(blocks, facts).collect()}
    assert got == {
        "a": "Observed: The verified mean was 2.50.",
        "b": "The verified mean was 2.50. end Small cell.",
        "c": "No token.",
    }
    other = spark.createDataFrame([("d", "other", "en", 1, "s", [], None, "[[FACT:elsewhere]]")], BLOCKS)
    assert narrative.expand_fact_tokens(other, facts).head()["text"] == "Not here [[FACT:large]]."
    empty = other.withColumn("prose", F.lit(None).cast("string"))
    assert narrative.expand_fact_tokens(empty, facts).head()["text"] == ""  # the block is not lost


def test_token_table(spark):
    blocks = spark.createDataFrame([block("a", "x [[FACT:a-b_1]] y [[FACT:]] [[FACT:c]]")], BLOCKS)
    rows = narrative.fact_token_table(blocks).orderBy("token_no").collect()
    assert [(r["token_no"], r["fact_id"]) for r in rows] == [(1, "a-b_1"), (2, "c")]


def test_payload_suppresses_small_cells_and_aliases(spark, facts):
    mine = facts.where("report_id = 'r'")
    payload = facts_ops.fact_payload(mine).collect()
    assert [(r["id"], r["token"], r["binding"]) for r in payload] == [("large", "[[FACT:large]]", "large")]
    shared = facts_ops.fact_payload(mine, share_labels=True).head()
    assert shared["binding"] == "The verified mean was 2.50."
    private = facts_ops.payload_json(
        facts_ops.fact_payload(mine), language="en", audience="researcher", depth="standard", study_context="private"
    ).head()["payload"]
    assert '"study_context":""' in private and "2.50" not in private and "rank" not in private


def test_payload_keeps_the_first_thirty_per_report(spark):
    rows = [(r, i, f"f{i:03d}", "k", 9, {}, "s", []) for r in ("p", "q") for i in range(50)]
    table = spark.createDataFrame(rows, FACTS).repartition(5)
    got = facts_ops.fact_payload(table).groupBy("report_id").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()
    assert {(r["report_id"], r["n"], r["m"]) for r in got} == {("p", 30, "f029"), ("q", 30, "f029")}


@pytest.mark.parametrize("partitions", [3])
def test_one_report_may_own_most_narratives(spark, facts, partitions):
    blocks = spark.range(2000).repartition(partitions).selectExpr(
        "cast(id as string) as response_id", "'r' as report_id", "'en' as language", "1 as block_no", "'s' as section_id",
        "array('large') as fact_ids", "'describe_direction' as interpretation_code",
        "if(id % 5 = 0, '[[FACT:gone]]', '[[FACT:large]]') as prose",
    )
    got = narrative.validate_narratives(blocks, facts, "en").groupBy("errors").count().collect()
    assert {(tuple(r["errors"]), r["count"]) for r in got} == {(("unknown_fact",), 400), ((), 1600)}


@pytest.mark.parametrize(
    "body,problems",
    [
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x"}]}', []),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x","fact_ids":["f"],"interpretation_code":null}]}', []),
        ('{"language":"xx","blocks":[{"section_id":"a","prose":"x"}]}', ["unknown_language"]),
        ('{"language":"en","blocks":[]}', ["block_count"]),
        ('{"language":"en"}', ["block_count"]),
        ('{"language":"en","blocks":[{"section_id":"a"}]}', ["missing_field"]),
        ('{"language":"en","extra":1,"blocks":[{"section_id":"a","prose":"x"}]}', ["unknown_field"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x","more":1}]}', ["unknown_field"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":5}]}', ["wrong_type"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x","fact_ids":"a"}]}', ["wrong_type"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x","fact_ids":[1]}]}', ["wrong_type"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x"}]} more', ["not_an_object"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x"}]}]', ["not_an_object"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x"}]}}', ["not_an_object"]),
        ('{"language":"en","blocks":[{"section_id":"a","prose":"x"}]},{}', ["not_an_object"]),
        ('{"language":"en","blocks":["a"]}', ["missing_field", "wrong_type"]),
        ("[1]", ["not_an_object"]),
        ("no json", ["not_an_object"]),
    ],
)
def test_response_schema(spark, body, problems):
    row = narrative.check_response_schema(spark.createDataFrame([("a", body)], "response_id string, body string")).head()
    assert row["problems"] == problems and row["conforms"] == (not problems)


def test_response_limits(spark):
    import json

    def body(blocks):
        return json.dumps({"language": "fi", "blocks": blocks})

    one = {"section_id": "s", "prose": "x"}
    rows = [
        ("nine", body([one] * 9)), ("eight", body([one] * 8)), ("long", body([{**one, "prose": "ä" * 3001}])),
        ("fits", body([{**one, "prose": "ä" * 3000}])), ("ids", body([{**one, "fact_ids": ["f"] * 31}])),
    ]
    table = spark.createDataFrame(rows, "response_id string, body string")
    got = {r["response_id"]: r["problems"] for r in narrative.check_response_schema(table).collect()}
    assert got == {"nine": ["block_count"], "eight": [], "long": ["prose_too_long"], "fits": [], "ids": ["too_many_fact_ids"]}


def test_responses_become_blocks(spark):
    table = spark.createDataFrame(
        [("a", "r", '{"language":"en","blocks":[{"section_id":"s","prose":"x"},{"section_id":"t","prose":"y","fact_ids":["f"]}]}')],
        "response_id string, report_id string, body string",
    )
    rows = narrative.parse_responses(table).orderBy("block_no").collect()
    assert [(r["block_no"], r["section_id"], r["fact_ids"], r["prose"]) for r in rows] == [(1, "s", [], "x"), (2, "t", ["f"], "y")]
