import math

import pytest
from pyspark.sql import functions as F

from loomline.functions import lists, numbers, stats, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def lit(v):
    return F.lit(v).cast("string")


def test_text_cleaning(spark):
    assert one(spark, text.clean_text(lit("  a\t b\n\nc "))) == "a b c"
    assert one(spark, text.clean_text(lit(None))) == ""
    assert one(spark, text.truncate_text(lit("abcdef gh"), 5)) == "abcd…"
    assert one(spark, text.truncate_text(lit("abc"), 5)) == "abc"
    assert one(spark, text.truncate_words(lit("a b, c d"), 2)) == "a b ..."
    assert one(spark, text.slugify(lit("--Ab c!"), fallback="x")) == "ab_c"
    assert one(spark, text.slugify(lit("!!"), fallback="x")) == "x"
    assert one(spark, text.clean_label(lit("-1_solar_power"))) == "solar_power"
    assert one(spark, text.drop_nullish(lit(" NaN "))) == ""
    assert text.normalized("a&amp;b​ c\r\n\n\n\n d ") == "a&b c\n\nd"


def test_decisions(spark):
    assert one(spark, text.yes_or_no(lit("Resposta: Sim."))) == "yes"
    assert one(spark, text.yes_or_no(lit("Não, porque"))) == "no"
    assert one(spark, text.yes_or_no(lit("nothing"))) is None
    assert one(spark, text.decision_status(text.review_decision(lit(" DELETE ")))) == "excluded"
    assert one(spark, text.decision_status(text.review_decision(lit("keep")))) == "aligned"
    assert one(spark, text.decision_status(text.review_decision(lit(None)))) == "aligned"
    assert one(spark, text.keyword_class(lit("Capital-market view"), text.FUNCTION_KEYWORDS)) == "market_strategy"
    assert one(spark, text.keyword_class(lit("partial match"), text.SAME_ISSUE_KEYWORDS)) == "adjacent_issue"


def test_html_paragraphs():
    page = "<html><script>x</script><p>One<p>Two &amp; more<ul><li>a</li><li>a</li></ul><p>- 12 -</p><table><tr><td><p>in</p></td><td>cell</td></tr></table><!-- no -->"
    assert text.paragraphs_of(page) == ["One", "Two & more", "a", "in", "cell"]
    assert text.paragraphs_of("<div>only <b>this</b></div>") == ["only this"]
    assert text.paragraphs_of(None) == [] and text.paragraphs_of("  ") == []


def test_json_object():
    assert text.json_object_in('ok {"a": "}", "b": {"c": 1}} tail') == '{"a": "}", "b": {"c": 1}}'
    assert text.json_object_in("none {") is None


def test_lists(spark):
    assert one(spark, lists.parse_terms(lit('["a", "b c"]'))) == ["a", "b c"]
    assert one(spark, lists.parse_terms(lit("['a', 'b']"))) == ["a", "b"]
    assert one(spark, lists.parse_terms(lit("['it's', 'b']"))) == ["it's", "b"]
    assert one(spark, lists.parse_terms(lit("a, b,, "))) == ["a", "b"]
    assert one(spark, lists.parse_terms(lit(None))) == []
    arr = lambda *v: F.array(*[lit(x) for x in v])
    assert one(spark, lists.stable_unique(arr("b", "a", "b", " ", None), 2)) == ["b", "a"]
    assert one(spark, lists.unique_ignoring_case(arr("Ab", "x", "aB"), 5)) == ["Ab", "x"]
    empty = F.array().cast("array<string>")
    assert one(spark, lists.jaccard(empty, empty)) is None
    assert one(spark, lists.jaccard(arr("a", "b"), arr("b", "c"))) == pytest.approx(1 / 3)
    assert one(spark, lists.at_year(lists.count_map(lit('{"2001": 4}')), F.lit(2001))) == 4
    assert one(spark, lists.at_year(lists.count_map(lit("bad")), F.lit(2001))) == 0


def test_numbers(spark):
    assert one(spark, numbers.number(lit("12.0"))) == 12.0
    assert one(spark, numbers.number(lit("NaN"))) is None and one(spark, numbers.number(lit("x"))) is None
    assert one(spark, numbers.sector(lit("1311"))) == "13" and one(spark, numbers.industry(lit("13"))) == "oil_gas"
    assert one(spark, numbers.sector(lit("111"))) == "01" and one(spark, numbers.industry(lit("99"))) is None
    assert [one(spark, numbers.least_topic_size(F.lit(n))) for n in (10, 325, 375, 9999)] == [5, 6, 8, 50]
    assert tuple(one(spark, numbers.phase_years(lit("from 2001 to 2005")))) == (2001, 2005)
    assert one(spark, numbers.strict_phase_years(lit("from 2001"))) is None
    assert tuple(one(spark, numbers.strict_phase_years(lit("2001 - 2003")))) == (2001, 2003)
    assert one(spark, numbers.safe_ratio(F.lit(1), F.lit(0))) is None and one(spark, numbers.safe_share(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numbers.combined_pattern(F.lit(2), F.lit(-0.1))) == "external_prior_peak_inverse_trajectories"


@pytest.mark.parametrize(("r", "n", "p"), [(-0.0561006307060838, 23, 0.79930615), (-0.7745222867390128, 23, 1.43786e-05)])
def test_published_p_values(spark, r, n, p):
    assert one(spark, stats.t_two_sided_p(F.lit(r), F.lit(n))) == pytest.approx(p, rel=1e-5)


def test_p_of_perfect_and_missing(spark):
    assert one(spark, stats.t_two_sided_p(F.lit(1.0), F.lit(6))) == pytest.approx(0, abs=1e-9)
    assert one(spark, stats.t_two_sided_p(F.lit(None).cast("double"), F.lit(6))) is None


def test_binomial(spark):
    def want(k, n):
        c = [math.comb(n, i) / 2**n for i in range(n + 1)]
        return sum(x for x in c if x <= c[k] * (1 + 1e-7))

    for k, n in ((0, 5), (3, 10), (5, 10), (9, 40)):
        assert one(spark, stats.binomial_p(F.lit(k), F.lit(n), "two-sided")) == pytest.approx(min(1, want(k, n)))
    assert one(spark, stats.binomial_p(F.lit(0), F.lit(0), "two-sided")) is None


@pytest.mark.parametrize("how", ["within", "table"])
def test_bh(spark, how):
    df = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03), ("a", 4, None)], "g string, i int, p double")
    out = stats.bh_within(df, "p", "q", ["g"], ["i"]) if how == "within" else stats.bh_table(df, "p", "q", ["i"], cells=3)
    assert [r[0] and round(r[0], 6) for r in out.orderBy("i").select("q").collect()] == [0.03, 0.04, 0.04, None]


def test_vectors(spark):
    assert one(spark, vectors.dot(vectors.unit(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1.0), F.lit(0.0)))) == pytest.approx(0.6)
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_sector_of_codes_of_any_width(spark):
    codes = {7: "00", 99: "00", 100: "01", 2834: "28", 9999: "99", 10_000: "100", 123_456: "1234", None: None}
    rows = spark.createDataFrame([(c,) for c in codes], "c long")
    assert {r.c: r.s for r in rows.select("c", numbers.sector(F.col("c")).alias("s")).collect()} == codes


def test_html_cells_and_nested_items():
    assert text.paragraphs_of("<table><tr><td><div>x</div></td><td>cell <h2>t</h2></td></tr></table>") == ["cell t", "t"]
    assert text.paragraphs_of("<ul><li>a<ul><li>b</li></ul></li><li>c</ul>") == ["a b", "b", "c"]
    assert text.paragraphs_of("<table><tr><td>1a<td>x<tr><td>y</table>") == ["1a", "x", "y"]
    assert text.paragraphs_of("<p>a<div>b</div><tr>r</tr>") == ["a", "r"]
    assert text.paragraphs_of("<div>only <b>this</b></div>") == ["only this"]


def test_classes_by_word_and_synonym(spark):
    issue = lambda v: one(spark, text.keyword_class(lit(v), text.SAME_ISSUE_KEYWORDS, text.SAME_ISSUE_SYNONYMS))
    assert [issue(v) for v in ("none", "Yes", "true", "direct-match", "Weak match", "partial overlap", "", None, "zzz")] == ["weak_match", "same_issue", "same_issue", "same_issue", "weak_match", "adjacent_issue", "", "", "zzz"]
    relation = lambda v: one(spark, text.keyword_class(lit(v), text.RELATION_KEYWORDS))
    assert [relation(v) for v in ("none", "Same function", "similar aims", "mixed", "unclear")] == ["different_function", "same_function", "same_function", "unclear", "unclear"]
    assert [one(spark, text.keep_or_exclude(lit(v))) for v in (" Exclude ", "excluded", None)] == ["exclude", "keep", "keep"]
    assert one(spark, text.without_stop_words(F.array(lit("the"), lit("grid")))) == ["grid"]


def test_label_of_a_class_is_made_once(spark):
    """the label was worked out anew for every word that it was compared with."""
    c = text.keyword_class(lit("Capital-market view"), text.FUNCTION_KEYWORDS)
    assert str(c).count("regexp_replace") == 3
    assert one(spark, text.keyword_class(lit(None).cast("string"), text.FUNCTION_KEYWORDS)) == ""
