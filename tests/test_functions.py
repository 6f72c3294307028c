import pytest
from pyspark.sql import functions as F

from ranksheaf.functions import citations, rouge, sets, text


def one(spark, **columns):
    """The values of column expressions on one row."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def strings(*xs):
    return F.array(*(F.lit(x) for x in xs)).cast("array<string>")


@pytest.mark.parametrize("value,keep", [("", False), ("   ", False), ("_____", False), ("- - = .", False), ("\t\n", False), (" ", False), ("a_", True), ("๑", True), ("-a-", True), (None, False)])
def test_paragraph_filter(spark, value, keep):
    assert one(spark, x=text.is_valid_paragraph(F.lit(value).cast("string"))).x is keep


@pytest.mark.parametrize("value,want", [('"P1"', ["P1"]), ('["P1","P2"]', ["P1", "P2"]), ("null", []), ("[]", []), (None, [])])
def test_refs_coercion(spark, value, want):
    assert one(spark, x=sets.as_list(F.parse_json(F.lit(value).cast("string")))).x == want


@pytest.mark.parametrize("value,want", [("", []), (None, []), ("P1", ["P1"]), ("P1, P2", ["P1", "P2"]), ("P1,,P2", ["P1", "", "P2"])])
def test_refs_csv(spark, value, want):
    assert one(spark, x=sets.parse_refs(F.lit(value).cast("string"))).x == want


def test_refs_csv_blanks_can_go(spark):
    assert one(spark, x=sets.parse_refs(F.lit("P1,,P2"), keep_blank=False)).x == ["P1", "P2"]


@pytest.mark.parametrize(
    "gold,found,scored,plain,lab",
    [([], [], 0.0, 0.0, 1.0), ([], ["P1"], 0.0, 0.0, 0.0), (["P1"], [], 0.0, 0.0, 0.0), (["P1", "P1"], ["P1"], 1.0, 1.0, 1.0), (["P1"], ["P2"], 0.0, 0.0, 0.0), (["P1", "P2"], ["P2", "P3"], 1 / 3, 1 / 3, 1 / 3)],
)
def test_iou_variants(spark, gold, found, scored, plain, lab):
    g, f = strings(*gold), strings(*found)
    r = one(spark, a=sets.iou_scored(g, f), b=sets.jaccard(g, f), c=sets.iou_lab(g, f))
    assert (r.a, r.b, r.c) == pytest.approx((scored, plain, lab))


@pytest.mark.parametrize(
    "answer,every,first",
    [
        ("x [อ้างอิง: 2, 3]", [1, 2], [1, 2]), ("x [อ้างอิง: 2] y [อ้างอิง: 1]", [1, 0], [1]), ("x [อ้างอิง: 2,2]", [1], [1, 1]), ("x [อ้างอิง: 99]", [0], [0]),
        ("x [อ้างอิง 3]", [2], [2]), ("x [อ้างอิง: ๒]", [0], [0]), ("no tag", [0], [0]), ("x [อ้างอิง: 99999999999999]", [0], [0]),
    ],
)
def test_citations(spark, answer, every, first):
    r = one(spark, a=citations.cited(F.lit(answer), F.lit(5)), b=citations.cited_first(F.lit(answer), F.lit(5)))
    assert (r.a, r.b) == (every, first)


def test_tags_go(spark):
    r = one(spark, a=citations.without_tags(F.lit("one [อ้างอิง: 1] two")), b=citations.without_tags(F.lit(" [อ้างอิง: 1]")), c=citations.before_last_tag(F.lit("a [อ้างอิง: 1] b [อ้างอิง: 2]")))
    assert (r.a, r.b, r.c) == ("one two", "", "a [อ้างอิง: 1] b")
    assert one(spark, x=citations.answer_or_fallback(F.lit(""), F.lit("first"), F.lit("q"))).x == "first"


@pytest.mark.parametrize("answer,want", [("<think>a\nb</think> c", "c"), ("a</think>b", "b"), ("plain", "plain")])
def test_thoughts_go(spark, answer, want):
    assert one(spark, x=citations.without_thoughts(F.lit(answer))).x == want


def test_two_lines(spark):
    a, u = citations.two_lines(F.lit("คำตอบ: yes\nย่อหน้าที่ใช้： ๒, 1"), F.lit(3))
    b, v = citations.two_lines(F.lit("nothing"), F.lit(3))
    r = one(spark, a=a, u=u, b=b, v=v)
    assert (r.a, r.u, r.b, r.v) == ("yes", [1, 0], "", [])


def test_picked(spark):
    r = one(spark, a=citations.picked(F.lit("number ๓ it is"), F.lit(5)), b=citations.picked(F.lit("7"), F.lit(5)), c=citations.picked(F.lit("none"), F.lit(5)))
    assert (r.a, r.b, r.c) == (3, None, None)


def test_longest_common_subsequence():
    import random

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert rouge.lcs_length(a, b) == slow(a, b)


def test_rouge_edges(spark):
    r = one(spark, a=rouge.rouge_l(strings(), strings()), b=rouge.rouge_l(text.spaced_tokens(strings()), text.spaced_tokens(strings())), c=rouge.rouge_l(strings("a"), strings("b")), d=rouge.rouge_l(strings("a", "b"), strings("a", "b")))
    assert (r.a, r.b, r.c, r.d) == (0.0, 1.0, 0.0, 1.0)


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    r = one(spark, zero=sets.normalised(v(0, 0)), unit=sets.normalised(v(3, 4)), same=sets.blended(v(1, 0), v(0, 1), F.lit(0.0)), none=sets.max_sim(F.array().cast("array<array<double>>"), F.array(v(1, 0))), sim=sets.max_sim(F.array(v(1, 0), v(0, 1)), F.array(v(1, 0))))
    assert r.zero == [0.0, 0.0] and r.unit == pytest.approx([0.6, 0.8]) and r.same == [1.0, 0.0] and r.none == 0.0 and r.sim == 1.0


def test_gather_and_places(spark):
    r = one(spark, a=sets.gathered(strings("P1", "P2"), F.array(F.lit(1), F.lit(9))), b=sets.places(strings("P1", "P2"), strings("P2", "P9", "P1")))
    assert (r.a, r.b) == (["P2"], [1, 2])


def test_truncation(spark):
    r = one(spark, a=text.truncate_chars(F.lit("abcdef"), 3, "..."), b=text.truncate_chars(F.lit("ab"), 3, "..."), c=text.truncate_sentences(F.lit("a\nb\nc"), 2), d=text.fold_digits(F.lit("๑๒")), e=text.strip_answer_label(F.lit("คำตอบ: x")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("abc...", "ab", "a\nb", "12", "x")
